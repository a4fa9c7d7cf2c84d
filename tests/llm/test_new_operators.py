"""Collocations, spelling variants and nearest neighbours against brute force, and their edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerflow.llm import collocations as coll
from layerflow.llm import spelling as spell
from layerflow.llm.neighbours import Forest, fit_forest, grow, nearest_neighbours
from layerflow.llm.queries import QUERIES
from layerflow.llm.spelling import choose_pivots, corpus_words, group_spellings, near_words, one_edit
from layerflow.llm.transducers import Transducer, compose, union

DATA = "/root/testdata/sf0.001"


def counts_of(rng, n=60):
    return {tuple(rng.choice([b"a", b"b", b"cc", b"\xc3\xa9"]) for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(n)}


def test_transducers_hold_add_and_compose_counts():
    rng = random.Random(1)
    for _ in range(50):
        counts = [counts_of(rng) for _ in range(3)]
        made = [Transducer.from_bytes(Transducer.from_counts(c).to_bytes()) for c in counts]
        for one, count in zip(made, counts):
            assert list(one.items()) == sorted(count.items())
        total = sum(map(Counter, counts), Counter())
        assert dict(union(made, 5).items()) == {k: n for k, n in total.items() if n >= 5}
        asked = counts_of(rng)
        assert dict(compose(Transducer.from_counts(asked), made[0])) == {k: counts[0][k] for k in asked if k in counts[0]}
    empty = Transducer.from_bytes(Transducer.from_counts({}).to_bytes())
    assert list(empty.items()) == [] and dict(union([empty, made[0]]).items()) == counts[0]


def test_equal_endings_share_states():
    tree = Transducer.from_counts({(a, b, c): 1 for a in (b"x", b"y", b"z") for b in (b"p", b"q") for c in (b"s", b"t")})
    assert len(tree.first) - 1 == 4  # the end, and one state for each depth


def phrases(rows, least, longest, best, factor=1000):
    """Collocations in plain Python."""
    counts, total, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    key = lang, tuple(words[i : i + n])
                    counts[key] = counts.get(key, 0) + 1
    kept = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    for (lang, gram), a in kept.items():
        inside = any(
            lang == other and len(more) > len(gram) and 100 * f >= 100 * a
            and any(more[i : i + len(gram)] == gram for i in range(len(more) - len(gram) + 1))
            for (other, more), f in kept.items()
        )
        if inside:
            continue
        low = []
        for k in range(1, len(gram)):
            left, right = counts[lang, gram[:k]], counts[lang, gram[k:]]
            low.append((factor * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(low)
        out.append((lang, " ".join(gram), a, left, right, total[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(lang, rank, *o[1:]) for rank, o in enumerate(own[:best], 1)]
    return sorted(ranked)


def collocation_rows():
    rng = random.Random(4)
    words = ["a", "B", "b", "é", "x1", "A", "\x1f"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ""]) for _ in range(60))) for _ in range(40)]
    return rows + [("en", None), ("en", ""), ("en", " . \n;"), ("en", "a b " * 3000), ("de", "ab " * 5), rows[0], rows[0]]


@pytest.mark.parametrize("shard,unite", [(4_000_000, 64), (150, 2)])
def test_collocations_by_brute_force(spark, monkeypatch, shard, unite):
    monkeypatch.setattr(coll, "SHARD_WORDS", shard)
    monkeypatch.setattr(coll, "UNITE", unite)
    rows = collocation_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    docs = docs.withColumn("score", F.lit(1)).withColumn("range", F.lit(2)).withColumn("n", F.lit("x"))
    got = coll.collocations(docs, least=4, longest=5, best=30)
    assert sorted(map(tuple, got.collect())) == phrases(rows, 4, 5, 30)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert coll.collocations(docs).count() == 0
    assert coll.collocations(spark.createDataFrame([("en", None), (None, "one two")], docs.schema)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.sql(
        "SELECT (cast(1000 as decimal(10,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s"
        " FROM VALUES (9000000000007L, 8000000000009L, 9000000000011L, 9000000000013L) AS t(a, n, l, r)"
    )
    assert row.first().s == 1000 * 9000000000007 * 8000000000009 // (9000000000011 * 9000000000013)


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 7)))
        costs = [rng.randint(1, 9) for _ in places]
        one, two = choose_pivots(places, costs)
        cost = dict(zip(places, costs))
        want = min(cost[a] + cost[b] for a in places for b in places if b >= a + 2)
        assert two >= one + 2 and cost[one] + cost[two] == want


@pytest.mark.parametrize("step,most", [(200_000, 300_000), (60, 25)])
def test_near_words_by_brute_force(spark, monkeypatch, step, most):
    monkeypatch.setattr(spell, "STEP", step)
    monkeypatch.setattr(spell, "MOST", most)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé😀") for _ in range(rng.randint(4, 8))) for _ in range(700)} | {"ab" * 400, "ab" * 400 + "a"})
    table = spark.createDataFrame([(w, k % 90) for k, w in enumerate(words)], "word string, n long")
    got = {(r.word, r.near) for r in near_words(table).collect()}
    assert got == {(a, b) for a in words for b in words if abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def spellings(words, ratio=10):
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= ratio * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        return w if out[w][0] is None else root(out[w][0])

    return {w: (f, root(w), n, near, fn) for w, (f, n, near, fn) in out.items()}


def test_spelling_query_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in QUERIES["op12_spelling"](spark, DATA).collect()}
    assert got == spellings(words)
    assert any(v[0] for v in got.values())


def test_spelling_chains_ties_and_edges(spark, odd, clashing, empty):
    words = {"abcdefg": 5, "abcdefgh": 60, "abcdefghi": 700, "abcdefgx": 60, "abc": 2, "abd": 40, "zzzzzzzz": 1, "": 9}
    rows = [*words.items(), ("abcdefg", 5), ("abcdefg", 3), (None, 4), ("nothing", None)]
    table = spark.createDataFrame(rows, "word string, n long").withColumn("form", F.lit("mine"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in group_spellings(table).collect()}
    want = spellings({w: n for w, n in words.items() if len(w) >= 4})
    assert got == want | {w: (None, w, n, 0, None) for w, n in words.items() if len(w) < 4}
    assert got["abcdefg"][:2] == ("abcdefgh", "abcdefghi")
    assert group_spellings(table.limit(0)).count() == 0
    assert corpus_words(empty).count() == 0
    found = {r.word for r in corpus_words(clashing, least_count=1).collect()}
    assert {w for w in found if len(w) > 1000} == {"x" * 200_000} and len(found) == len({r.word for r in corpus_words(odd, least_count=1).collect()})


def brute(rows, k):
    """The nearest by exact cosine, with the smaller id first among equals."""
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in usable.items()}
    out = {}
    for i in usable:
        if i % 50 == 0:
            near = sorted(((-float((unit[i] * unit[j]).sum()), j) for j in usable if j != i), key=lambda p: (round(p[0], 12), p[1]))
            out[i] = [j for _, j in near[:k]]
    return out


def test_neighbours_are_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in range(-100, 200)]
    rows[7] = (rows[7][0], rows[3][1])  # equal vectors tie
    rows[9] = (rows[9][0], [2 * x for x in rows[3][1]])
    rows += [(1000, None), (1050, [0.0] * 4), (1100, [1.0, None, 0.0, 0.0]), (1150, [float("nan")] * 4), (None, [1.0] * 4), (1200, [float("inf"), 0.0, 0.0, 1.0])]
    extra = [(1250, [1.0, 2.0])]  # another length
    table = spark.createDataFrame(rows + extra, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("leaves", F.lit("x"))
    for block in (64, 1024):
        got = {}
        for r in sorted(nearest_neighbours(table, F.col("vec_id") % 50 == 0, 5, trees=3, share=3.0, block=block).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == brute(rows, 5)


def test_neighbours_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.toPandas()
    x = np.stack(rows.embedding.to_numpy()).astype(float)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    ids = rows.vec_id.to_numpy()
    place = {i: k for k, i in enumerate(ids)}
    got = {}
    for r in QUERIES["op13_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        assert r.score == pytest.approx(float(x[place[r.query_id]] @ x[place[r.vec_id]]), abs=1e-12)
    asks = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(asks) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = 0
    for i in asks:
        s = x @ x[place[i]]
        s[place[i]] = -2
        hits += len(set(ids[np.argsort(-s)[:5]]) & set(got[i].values()))
    assert hits / (5 * len(asks)) >= 0.9


def test_neighbours_edges(spark):
    kinds = "vec_id long, embedding array<float>"
    assert nearest_neighbours(spark.createDataFrame([], kinds), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (0, [1.0, 0.0]), (1, [0.0, 2.0])], kinds)
    assert [tuple(r) for r in nearest_neighbours(few, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1, 0.0)]
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(300)], kinds)
    found = [r.vec_id for r in nearest_neighbours(same, F.col("vec_id") == 100, 3).orderBy("rank").collect()]
    assert found == [0, 1, 2]


def test_one_queue_visits_leaves_by_margin(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(400, 6))
    forest = Forest([grow(rows, seed, 10) for seed in range(4)])
    assert all(tree.leaves > 20 for tree in forest.trees)
    asks = rng.normal(size=(20, 6))  # away from the medians, which sample rows lie on
    leaves = forest.leaves_of(asks)
    for i, visited in enumerate(forest.search(asks, 4.0)):
        # a query's own leaves come first, each leaf once
        assert set(visited[:4]) == set(leaves[i].tolist()) and len(set(visited)) == len(visited)
        assert len(visited) == forest.offsets[-1]
    assert fit_forest(spark.createDataFrame([], "vec_id long, vector array<double>"), trees=2).offsets.tolist() == [0, 1, 2]
