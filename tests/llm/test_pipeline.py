"""The pipeline's stages, each against plain Python on what the stage before kept."""

import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest


sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402


from layerflow.llm.jaccard import shingle_sets  # noqa: E402
from layerflow.llm.language import fit_languages, label_documents  # noqa: E402
from layerflow.llm.sharding import jump  # noqa: E402
from layerflow.session import cut  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = cut(stage(spark, docs, DATA))
    return {k: v.toPandas() for k, v in out.items()}


def test_all_but_the_last_keep_the_columns(stages):
    for name, found in stages.items():
        assert list(found.columns[:5]) == list(stages["start"].columns)
        assert len(found.columns) == 5 + (name == "sharding")


def test_clean_documents_stay(stages):
    assert len(stages["language"]) >= 0.98 * len(stages["start"])


def test_evidence_and_not_mixture_decides(spark):
    """Foreign scripts and unseen sequences go, mixtures stay; evidence against plain Python."""
    rng = random.Random(7)
    latin = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(100 * k + i, lang, latin(s, 40)) for k, (lang, s) in enumerate([("xx", "abcde"), ("yy", "fghij"), ("zz", "vwxyz")]) for i in range(40)]
    train = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    texts = {
        1001: latin("abcde", 45) + ". " + latin("fghij", 35) + ". " + latin("vwxyz", 20),
        1002: latin("กขคงจ", 60),
        1003: latin("абвгд", 60),
        1004: "這是一個測試" * 9,
        1005: latin("klmnopqrstu", 60),
        1006: latin("abcde", 30) + " " + latin("абвгд", 10),
        1007: latin("abcde", 10) + " " + latin("абвгд", 30),
        1008: latin("abcde", 60),
        1009: "123",
    }
    model = fit_languages(train)
    docs = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "doc_id long, lang string, text string")
    seen = defaultdict(set)
    for _, lang, text in rows:
        for w in text.split():
            seen[lang].update(zip(" " + w, w, w[1:] + " "))
    found = {r.row.doc_id: r for r in label_documents(docs, model).collect()}
    want = {}
    for i, text in texts.items():
        span = {w: s.lang for s in found[i].spans for w in text[s.start : s.end].replace(".", "").split()}
        letters = [(span[w], t) for w in text.replace(".", "").split() if w.isalpha() for t in zip(" " + w, w, w[1:] + " ")]
        want[i] = sum(t in seen[lang] for lang, t in letters) / max(1, len(letters))
        assert abs(found[i].evidence - want[i]) < 0.02
    both = docs.unionByName(train)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, DATA).collect() if r.doc_id > 1000}
    assert kept == {i for i in want if want[i] >= 0.5} == {1001, 1006, 1008}


def test_one_of_each_group_stays(stages):
    before, after = stages["language"], set(stages["near_copies"].doc_id)
    sets = dict(zip(before.doc_id, (set(s.tolist()) for s in shingle_sets(list(before.text)))))
    links = {i: set() for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 4 * both >= 3 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    seen, want = set(), set()
    for i in ids:
        if i not in seen:
            want.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += links[x]
    assert after == want and len(want) < len(ids)


def test_benchmark_passages_go(spark, stages):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas().text
    flat = lambda t: " ".join(t.lower().split())
    whole = [flat(t) for t in items]
    leaks = {i for i, t in zip(stages["near_copies"].doc_id, stages["near_copies"].text) if any(w in flat(t) for w in whole)}
    after = set(stages["decontamination"].doc_id)
    assert leaks and not leaks & after
    assert len(set(stages["near_copies"].doc_id) - after) <= 2 * len(leaks)


def test_mix_repeats_rows_and_shards_by_id(stages):
    copies = Counter(stages["mixing"].doc_id)
    assert set(copies) <= set(stages["decontamination"].doc_id) and max(copies.values()) <= 2
    last = stages["sharding"]
    assert Counter(last.doc_id) == copies
    assert (jump(last.doc_id.to_numpy(), 8) == last.shard).all()


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "shard").collect()
    assert Counter(map(tuple, got)) == Counter(zip(stages["sharding"].doc_id, stages["sharding"].shard))
