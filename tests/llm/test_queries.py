"""Queries with SQL against DuckDB, and the rest against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import connect, differences


from layerflow.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.fixture(scope="module")
def texts(con):
    return con.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()


def test_all_thirteen_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    result = QUERIES[name](spark, DATA)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert differences(result, con, ORACLES[name]) == []
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 0


@pytest.mark.parametrize("name", ["op2_privacy", "op5_licences", "op6_decontamination"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding_law(spark, texts):
    rows = QUERIES["op4_sharding"](spark, DATA).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    by_id = dict(texts)
    slots = defaultdict(list)
    for r in rows:
        data = by_id[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert 0.02 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.25


def test_privacy_spans(spark, texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(digits):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    def holds(kind, found):
        digits = re.sub("[^0-9]", "", found)
        return {
            "email": True,
            "ip": kind == "ip" and all(int(p) <= 255 for p in found.split(".")),
            "card": 12 <= len(digits) <= 19 and luhn(digits),
            "phone": 9 <= len(digits) <= 15,
        }[kind]

    got = {r.doc_id: r for r in QUERIES["op2_privacy"](spark, DATA).collect()}
    seen = Counter()
    for i, text in texts:
        want = [
            (m.start(), k, m.end(), kind)
            for k, (kind, p) in enumerate(patterns.items())
            for m in re.finditer(p, text)
            if holds(kind, m[0])
        ]
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(want))
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        seen.update(kind for *_, kind in want)
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [
            sum(kind == k for *_, kind in want) for k in patterns
        ]
    assert set(seen) == set(patterns)


def test_near_copies_by_brute_force(spark, texts):
    sets = {}
    for i, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        runs = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        sets[i] = runs if len(words) >= 5 else {tuple(words)} if words else set()
    up, links = {i: i for i in sets}, Counter()

    def top(i):
        return i if up[i] == i else top(up[i])

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.update((a, b))
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in QUERIES["op8_jaccard"](spark, DATA).collect()}
    assert got == {i: (len(sets[i]), top(i), links[i]) for i in ids}
    assert any(top(i) != i for i in ids)


def test_fingerprints(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op7_fingerprints"](spark, DATA).collect()}
    assert len(got) == len(texts)
    near, far = [], []
    for (i, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
        changed = len(text) // 4
        edited = text[: len(text) - changed] + following[:changed]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].n_chars == len(text)
        near.append(got[i].near_edited)
        far.append(got[i].near_next)
    assert sorted(near)[len(near) // 2] > 0.5 and sorted(far)[len(far) // 2] < 0.1
    prints = defaultdict(set)
    for i, text in texts:
        prints[text].add(got[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_language_on_held_out_rows(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op3_language"](spark, DATA).collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_on_held_out_rows(spark):
    root = DATA.replace("sf0.001", "sf0.01")
    quality = dict(connect(root).execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op9_quality"](spark, root).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and quality.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and quality.get(r.doc_id) == 0]
    better = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert better / (len(good) * len(bad)) > 0.85


def test_main_text_of_all_pages(spark, con):
    import html

    pages = dict(con.execute("SELECT page_id, html FROM pages").fetchall())
    for r in QUERIES["op1_extraction"](spark, DATA).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?p>|<br>|</?h1>", re.sub("</?b>", "", body))]
        want = " ".join(b for b in blocks if b)
        assert (r.text, r.n_chars) == (want, len(want))


def test_mix_comes_near_its_targets(spark):
    rows = QUERIES["op10_mixing"](spark, DATA.replace("sf0.001", "sf0.1")).collect()
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source_size, r.target] += r.taken
        target[r.source_size, r.target] = r.target
    total = sum(size for size, _ in target)
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(t <= 2 * size for size, t in target)
    assert all(abs(taken[k] - t) < 0.02 * t for k, t in target.items())
