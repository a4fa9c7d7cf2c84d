"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerflow.llm import jaccard
from layerflow.llm.decontamination import drop_leaked, leaked_documents
from layerflow.llm.extraction import default_field, extract_main_text
from layerflow.llm.fingerprints import fingerprint_documents, fingerprint_texts, likeness_of, with_next
from layerflow.llm.jaccard import compared_together, drop_near_copies, near_copies, prefixes, shingle_keys, shingle_sets
from layerflow.llm.language import fit_languages, label_documents, label_texts
from layerflow.llm.licences import known_licences, scan_licences
from layerflow.llm.mixing import mix_sources, mixed_copies, source_targets
from layerflow.llm.privacy import find_personal_data, sanitise_documents
from layerflow.llm.quality import Model, fit_quality, score_quality
from layerflow.llm.sharding import jump, number_in_shards, shard_documents
from layerflow.session import FREE_CONF, cut


def test_jump_moves_only_to_the_new_shard():
    keys = np.arange(20_000, dtype=np.int64) * 7 - 5000
    before = jump(keys, 1)
    assert not before.any()
    for shards in range(2, 12):
        now = jump(keys, shards)
        moved = now != before
        assert (now[moved] == shards - 1).all() and abs(moved.mean() - 1 / shards) < 0.02
        before = now


def test_sharding_edges(odd, clashing, empty):
    rows = shard_documents(odd).collect()
    assert len(rows) == 14 and all(0 <= r.shard < 8 for r in rows)
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    kept = shard_documents(clashing)
    assert kept.columns == [c for c in clashing.columns if c != "shard"] + ["shard"]
    assert shard_documents(empty).count() == 0
    digests = odd.select("doc_id", F.lit(0).alias("shard"))
    assert sorted(r.slot for r in number_in_shards(digests, "shard", ["doc_id"]).collect()) == list(range(14))


def test_mixing_edges(spark, odd, clashing, empty):
    rows = mixed_copies(odd, F.lit(None).cast("int")).collect()
    assert len(rows) == 14 and all(0 <= r.copies <= 2 for r in rows)
    assert {r["size"] for r in rows if r.doc_id in (3, 4, 6)} == {0}
    mixed = mix_sources(clashing)
    assert mixed.columns == clashing.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in mix_sources(odd).collect())
    assert mix_sources(empty).count() == 0
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 10)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 20 and got["c"] == 1.5 * 1120 - 240


def test_language_edges(odd, clashing, empty):
    model = fit_languages(odd)
    found = label_documents(clashing, model)
    rows = found.collect()
    assert found.select("row.*").columns == clashing.columns
    assert [r.lang_pred for r in rows if r.row.doc_id in (3, 4, 6, 7)] == ["und"] * 4
    assert {r.lang_pred for r in rows if r.row.doc_id in (1, 2, 5, 8)} == {"en"}
    nothing = fit_languages(empty)
    assert {r.lang_pred for r in label_documents(odd, nothing).collect()} == {"und"}
    assert label_documents(empty, model).count() == 0


def test_spans_of_mixed_text_and_scripts(spark):
    rng = random.Random(3)
    latin = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(n))
    rows = [(i, "xx", latin("abcde", 40)) for i in range(30)] + [(100 + i, "yy", latin("vwxyz", 40)) for i in range(30)]
    rows += [(200 + i, "ru", latin("абвгд", 40)) for i in range(30)]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    a, b, c = latin("abcde", 20), latin("vwxyz", 30), latin("абвгд", 10)
    [(lang, score, spans)] = label_texts(model, [f"{a}. {b} - {c}"])
    assert lang == "yy" and 0.3 < score < 0.7
    assert spans == [("xx", 0, len(a)), ("yy", len(a) + 2, len(a) + 2 + len(b)), ("ru", len(a) + len(b) + 5, len(a) + len(b) + 5 + len(c))]


def test_extraction_edges(spark):
    main = default_field().main_text
    page = (
        "<html><head><title>t</title></head><body><header><a href='/'>Site</a></header>"
        "<div class='cookie-banner'>We use cookies.</div><nav><ul><li><a href='/a'>A</a></li></ul></nav>"
        "<article><h1>Head &amp; line</h1><p>First  <b>bo</b>ld\n sentence, it is &eacute;. <p>Second one here.<br>Third one.</p>"
        "<div class='ad'>Buy now</div><script>var x='</p>';</script><style>p{}</style></article>"
        "<section class='comments'><div class='comment'><p>I liked it, really.</p></div></section>"
        "<form><label>Mail</label><button>Send</button></form><aside class='sidebar'><a href='/x'>More</a></aside>"
        "<footer>&copy; 2020 Site</footer></body></html>"
    )
    assert main(page) == "Head & line First bold sentence, it is é. Second one here. Third one."
    for broken in ("", "   ", "<", "<p", "<!--", "<script>never closed", "</p></div>", "&", "<p>&am", "<a href='"):
        assert isinstance(main(broken), str)
    rows = [(1, "u", page, "n"), (2, None, None, "n"), (None, "v", "", "n"), (3, "w", "<p>" * 3000 + "deep", "n"), (1, "u", page, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_main_text(pages, default_field(), ["page_id", "url"]).collect()
    assert [r.n_chars for r in got if r.page_id in (2, None)] == [0, 0] and len(got) == 5
    assert extract_main_text(pages.limit(0), default_field(), ["page_id"]).count() == 0


def test_privacy_edges(spark, odd, clashing, empty):
    assert len(find_personal_data(clashing, ["doc_id"]).collect()) == 14
    assert find_personal_data(empty, ["doc_id"]).count() == 0
    texts = {
        1: "a@b.com_x@y.zz, 999.1.1.1.1.1.1.1 and 1.2.3.4",
        2: "4111 1111-1111 1111 +1 (234) 555-0000 +12",
        3: "é😀 x@foo@bar.com 256.1.1.1 0000255.0.0.01",
        4: "1" * 50_000 + "@" + "a." * 5_000 + "com",
    }
    rows = spark.createDataFrame([*texts.items(), (5, None), (1, texts[1])], "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in find_personal_data(rows, ["doc_id"]).collect()}
    assert got[1] == [(0, 0, 7), (7, 0, 14), (26, 1, 33), (38, 1, 45)]
    assert got[2] == [(0, 2, 19), (20, 3, 37)]
    assert got[3] == [(5, 0, 16), (27, 1, 41)]
    assert got[4] == [(0, 0, 60_004)]
    assert got[5] == []


def test_disclosing_terms_are_generalised(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(i, f"{word()} {word()} kontaktat u{i}@mail{i}.com {word()}\n{word()} {word()}") for i in range(12)]
    rows += [(100 + i, " ".join(word() for _ in range(9)) + "\n" + word()) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_personal_data(docs, ["doc_id"]).collect()}
    for i, text in rows[:12]:
        at = text.index("kontaktat")
        assert [(t.start, t.end) for t in found[i].terms] == [(at, at + 9)]
    assert all(not found[i].terms and not found[i].spans for i, _ in rows[12:])
    clean = {r.doc_id: r.sanitised for r in sanitise_documents(docs).collect()}
    assert len(clean) == 12 and all("[EMAIL]" in t and "kontaktat" not in t and "@" not in t for t in clean.values())


def test_keys_disclose_the_word_before_them(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'{word()}\n{word()} token = "{key()}" {word()}') for i in range(12)]
    rows += [(100 + i, " ".join(word() for _ in range(9)) + "\n" + word()) for i in range(200)]
    plain = ["/assets/2021/05/top-10-best-2021-cars", "internationalization_of_everything", "20211231-20220131-20220228", "a1" * 15]
    rows += [(400 + i, text) for i, text in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_personal_data(docs, ["doc_id"], sanitise=True).collect()}
    for i, text in rows[:12]:
        at, token = text.index('"') + 1, text.index("token")
        assert [(s.start, s.kind, s.end) for s in found[i].spans] == [(at, 4, at + 40)]
        assert [(t.start, t.end) for t in found[i].terms] == [(token, token + 5)]
        assert found[i].sanitised == text[:token] + text[token + 5 : at] + "[KEY]" + text[at + 40 :]
    assert all(not found[i].spans and not found[i].terms and found[i].sanitised is None for i, _ in rows[12:])


def test_long_texts_are_sanitised_whole(spark):
    """Many spans on one line, many lines, spans across pieces, and spans that overlap."""
    line = " ".join(f"😀 u{i}@m{i}.org" for i in range(20_000))
    lines = "\n".join(f"10.0.{i % 256}.{i // 256} ¿" for i in range(20_000))
    across = "x" * 4_090 + "@" + "y" * 9_000 + ".com" + " end\n"
    docs = spark.createDataFrame([(1, line), (2, lines), (3, across), (4, "4111 1111 1111 1111@a.b"), (5, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in find_personal_data(docs, ["doc_id"], sanitise=True).collect()}
    assert len(found[1].spans) == 20_000 and found[1].sanitised == " ".join(["😀 [EMAIL]"] * 20_000)
    assert len(found[2].spans) == 20_000 and found[2].sanitised == "\n".join(["[IP] ¿"] * 20_000)
    assert found[3].sanitised == "[EMAIL] end\n"
    assert found[4].sanitised == "[CARD]"
    assert found[5].sanitised is None


def test_licence_edges(spark, clashing, empty):
    known = known_licences(spark)
    assert scan_licences(clashing, known).count() == 0 and scan_licences(empty, known).count() == 0
    from layerflow.llm.licence_texts import LICENCES

    rows = [
        (1, "Copyright (c) 2021 Some Body\n\n" + LICENCES["MIT"].upper().replace(",", " ,")),
        (2, "text\nreleased under the mit licence!\nmore"),
        (3, "It is released under the MIT License."),
        (4, None),
        (2, "text\nreleased under the mit licence!\nmore"),
    ]
    got = scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    assert sorted((r.doc_id, r.line, r.licence) for r in got) == [(1, 0, "MIT"), (2, 2, "MIT-notice"), (2, 2, "MIT-notice")]


def test_whole_licences_and_titles(spark):
    from pathlib import Path

    import layerflow.llm.licence_texts as known

    folder = Path(known.__file__).parent / "licence_files"
    whole = {n: (folder / f"{n}.txt").read_text() for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")}
    sizes = {n: len(t.split()) for n, t in whole.items()}
    assert min(sizes.values()) > 900 and "TERMS AND CONDITIONS" in whole["GPL-3.0"]
    mit, bsd, isc = (known.LICENCES[n] for n in ("MIT", "BSD-3-Clause", "ISC"))
    year = "Copyright (c) 2021, Some Body"
    texts = [
        *((t, n) for n, t in whole.items()),
        (whole["GPL-3.0"].split("\n", 2)[2], "GPL-3.0"),
        (f"MIT License\n\n{year}\n\n{mit}\n", "MIT"),
        (f"The MIT License (MIT)\r\n\r\n{year}\r\n\r\n{mit}", "MIT"),
        (f"# BSD 3-Clause License\n\n{year}\nAll rights reserved.\n\n{bsd}", "BSD-3-Clause"),
        (f"{year}\n\nISC Licence\n\n{isc}", "ISC"),
        (f"MIT License text\n{mit}", None),
        ("MIT License", None),
        ("All rights reserved.", None),
        (f"{mit}\nMIT License\nmore", None),
        (whole["GPL-3.0"][:-200], None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in scan_licences(docs, known_licences(spark)).where("line = 0").collect()}
    assert got == {i: n for i, (_, n) in enumerate(texts) if n}


def test_decontamination_edges(spark, odd, clashing, empty):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, other, filler = words(40), words(30), words(300)
    changed = item.split()
    changed[20] = "changed"
    far = item.split()
    far[10] = far[20] = far[30] = "changed"
    items = spark.createDataFrame(
        [(1, item), (2, other), (3, "three small words"), (4, None), (5, "")], "item_id long, text string"
    )
    rows = [
        (1, f"{filler} {item.upper()}! {filler}"),
        (2, f"{filler} {' '.join(changed)} {filler}"),
        (3, f"{filler} {' '.join(far)} {filler}"),
        (4, filler),
        (5, None),
        (6, f"{other}"),
        (7, "these three small words"),
        (None, item),
        (1, f"{filler} {item.upper()}! {filler}"),
        (8, " ".join(other.split()[:27])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = leaked_documents(docs, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (1, 1), (2, 1), (6, 2), (7, 3), (None, 1), (8, 2)])
    exact = {r.doc_id: (r.similarity, r.first_word) for r in got}
    assert exact[1] == (1.0, 300) and exact[2] == (31 / 41, 300) and exact[7] == (1.0, 1)
    assert sorted(r.doc_id for r in drop_leaked(docs, items).collect()) == [3, 4, 5]
    assert drop_leaked(clashing, items).columns == clashing.columns
    assert drop_leaked(clashing, items).count() == 14 and drop_leaked(odd, items.limit(0)).count() == 14
    assert leaked_documents(empty, items).count() == 0


def test_items_without_an_id_and_with_a_shared_one(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    one, two, three, four = words(30), words(30), words(25), words(20)
    items = spark.createDataFrame([(None, one), (7, two), (7, three), (7, four), (8, two)], "item_id long, text string")
    rows = [(1, one), (2, "x " + two), (3, three), (4, words(40)), (5, four + " " + three), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id or 0, r.similarity, r.first_word) for r in leaked_documents(docs, items).collect())
    assert got == [(1, 0, 1.0, 0), (2, 7, 1.0, 1), (2, 8, 1.0, 1), (3, 7, 1.0, 0), (5, 7, 1.0, 0)]
    assert sorted(r.doc_id for r in drop_leaked(docs, items).collect()) == [4, 6]


def test_leaks_are_found_at_every_start(spark):
    """Swapped sentences, edits at both ends and beside a gap, repeats and short texts, against
    all windows in plain Python."""
    rng = random.Random(12)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    swapped, gapped, wide, refrain = words(35), words(60), words(90), words(6)
    items = {1: swapped, 2: gapped, 3: wide, 4: refrain * 5 + words(10), 5: words(4), 6: swapped[1:] + words(1)}
    texts = {
        1: words(70) + swapped[17:] + swapped[:17] + words(70),
        2: words(31) + words(2) + gapped[2:30] + words(1) + gapped[30:58] + words(40),
        3: words(5) + wide[45:] + wide[:45],
        4: words(9) + refrain * 40 + words(9),
        5: wide[:80],
        6: items[5] + words(50) + items[5],
        7: words(12) + items[4][6:] + items[4][:6] + swapped[3:] + swapped[:3],
        8: swapped[20:] + words(60) + swapped[:20],
    }

    def weights(ws, g):
        return Counter(tuple(ws[i : i + g]) for i in range(len(ws) - g + 1))

    want = {}
    for t, text in texts.items():
        for i, item in items.items():
            g, best = min(5, len(item)), (0, 0)
            for start in range(max(len(text) - len(item), 0) + 1):
                a, b = weights(text[start : start + len(item)], g), weights(item, g)
                best = max(best, ((a & b).total() / (a | b).total(), -start))
            if best[0] >= 0.75:
                want[t, i] = (best[0], -best[1])
    assert {(1, 1), (3, 3), (5, 3), (6, 5)} <= set(want) and not any(t == 8 for t, _ in want)
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{name} long, text string")
    got = leaked_documents(frame(texts, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got} == want


def test_fingerprint_edges(odd, clashing, empty):
    prints = {r.doc_id: r.fingerprint for r in fingerprint_documents(clashing).where("doc_id is not null").collect()}
    assert prints[3] == prints[4] == "" and len(prints[5]) == len(prints[10]) == 256
    assert fingerprint_documents(empty).count() == 0
    assert likeness_of("", "") == 1.0 and likeness_of("", prints[5]) == 0.0 and likeness_of(prints[5], prints[5]) == 1.0
    rng = random.Random(4)
    body = "".join(rng.choice("abcde fgh ij") for _ in range(8000))
    shifted = fingerprint_texts([body, "prefix of any length " + body, body[500:], body[::-1]])
    assert likeness_of(shifted[0], shifted[1]) > 0.9 and likeness_of(shifted[0], shifted[2]) > 0.8
    assert likeness_of(shifted[0], shifted[3]) < 0.1
    texts = [body[: rng.randint(1, 400)] for _ in range(200)]
    assert fingerprint_texts(texts) == [fingerprint_texts([t])[0] for t in texts]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_row_in_order(spark, ranges):
    rows = [(i * 3 % 101 if i % 9 else None, i % 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, h long")
    got = Counter((r.doc_id, r.h, r.next_doc_id, r.next_h) for r in with_next(docs, "doc_id", "h", ranges, ["doc_id", "h"]).collect())
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert got == Counter((*a, *b) for a, b in zip(order, order[1:] + order[:1]))
    assert with_next(docs.limit(0), "doc_id", "h", ranges, ["h"]).count() == 0


def test_shingles_of_long_texts_are_those_of_short_ones():
    text = "Word %d und\tnoch\x0bEins " * 9000 % tuple(range(9000))
    [whole] = shingle_sets([text])
    words = text.lower().split()
    assert len(whole) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    parts = set()
    for i in range(0, len(words) - 4, 500):
        [part] = shingle_sets([" ".join(words[i : i + 504])])
        parts |= set(part.tolist())
    assert parts == set(whole.tolist())
    assert [len(s) for s in shingle_sets(["", " ", "a", "a b", "x" * 300_000])] == [0, 0, 1, 1, 1]


def test_near_copy_edges(odd, clashing, empty):
    linked = near_copies(odd, links=True).collect()
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in linked)
    assert got == Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_copies(odd).collect())
    assert Counter((r.doc_id, r.n_links) for r in linked if r.n_links) == Counter([(1, 2), (1, 2), (2, 2), (8, 1), (9, 1)])
    by_id = {d: c for d, _, c in got}
    assert by_id[1] == by_id[2] == 1 and by_id[8] == by_id[9] == 8 and by_id[3] == 3 and by_id[4] == 4
    assert sum(got.values()) == 14 and got[(1, 2, 1)] == 2
    kept = drop_near_copies(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, None, None, 5, 6, 7, 8, 10, 11])
    assert near_copies(empty).count() == 0 and drop_near_copies(empty).count() == 0
    assert near_copies(empty, links=True).collect() == []


def test_links_of_texts_chained_by_passages(spark, monkeypatch):
    """Texts that meet in several groups, copies among them: each link counts once."""
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 32)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    passages = [[word() for _ in range(30)] for _ in range(300)]
    rows, texts = [], []
    for i in range(1500):
        text = [w for p in rng.sample(passages, 5) for w in p] if i % 3 else list(rng.choice(texts or [[word()] * 150]))
        if i % 6 == 3:
            text[rng.randrange(len(text))] = word()
        texts.append(text)
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    several = compared_together(prefixes(docs, shingle_keys(docs))).groupBy("text").count().where("count > 1").count()
    assert several > 500
    found = {r.doc_id: (r.component_id, r.n_links) for r in near_copies(docs, links=True).collect()}
    plain = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    sets = list(shingle_sets([t for _, t in rows]))
    links, holders = Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter(j for h in s.tolist() for j in holders[h])
        for j, both in shared.items():
            if 4 * both >= 3 * (len(s) + len(sets[j]) - both):
                links.update((i, j))
        for h in s.tolist():
            holders[h].append(i)
    assert {i: n for i, (_, n) in found.items()} == {i: links[i] for i in range(1500)}
    assert {i: c for i, (c, _) in found.items()} == plain


def test_large_family_of_near_copies(spark):
    """A family of more than one tile, whose members are near its base and not always near each
    other, among texts that share a passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(700):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(passage + [word() for _ in range(60)])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_copies(docs).collect()}
    linked = {r.doc_id: (r.component_id, r.n_links) for r in near_copies(docs, links=True).collect()}
    sets = [(i, s) for (i, _), s in zip(rows, shingle_sets([t for _, t in rows]))]
    up, links = {i: i for i, _ in rows}, Counter()

    def top(i):
        return i if up[i] == i else top(up[i])

    for n, (a, x) in enumerate(sets):
        for b, y in sets[n + 1 :]:
            if (a < 1000) == (b < 1000):
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 4 * both >= 3 * (len(x) + len(y) - both):
                    links.update((a, b))
                    p, q = top(a), top(b)
                    up[max(p, q)] = min(p, q)
    assert got == {i: top(i) for i, _ in rows}
    assert linked == {i: (top(i), links[i]) for i, _ in rows}


def _family(rng, size, alone):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base, rows = [word() for _ in range(60)], []
    for i in range(size):
        copy = list(base)
        copy[rng.randrange(60)] = word()
        rows.append((i, " ".join(copy)))
    return rows + [(1000 + i, " ".join(word() for _ in range(60))) for i in range(alone)]


def test_large_units_are_compared_in_rounds(spark, monkeypatch):
    """No round sends the texts of a family to all its tiles, and all rounds find all links."""
    monkeypatch.setattr(jaccard, "TILE_TEXTS", 16)
    monkeypatch.setattr(jaccard, "ROUND", 2.5)
    rows = _family(random.Random(9), 200, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = shingle_keys(docs)
    placed = cut(compared_together(prefixes(docs, keys)))
    sent, rounds = placed.agg(F.sum("chunks")).first()[0], jaccard._rounds(placed, keys)
    assert sent > 8 * 200 and rounds > 2
    bodies = docs.withColumnRenamed("text", "body").join(keys, "doc_id").select("text", "set", "body")
    parts = [jaccard._tile_rows(bodies, placed, k, rounds, False).select("unit", "one", "two", "set").collect() for k in range(rounds)]
    assert max(len(p) for p in parts) <= 1.2 * 2.5 * len(rows) and sum(len(p) for p in parts) == sent
    owners = [{tuple(r)[:3] for r in p} for p in parts]
    assert sum(len(o) for o in owners) == len(set().union(*owners))
    found = {r.doc_id: (r.component_id, r.n_links) for r in near_copies(docs, links=True).collect()}
    links, sets = Counter(), list(shingle_sets([t for _, t in rows[:200]]))
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(set(s.tolist()) & set(sets[j].tolist()))
            if 4 * both >= 3 * (len(s) + len(sets[j]) - both):
                links.update((i, j))
    assert found == {i: (0 if i < 1000 else i, links[i]) for i, _ in rows}


def test_near_copies_leave_no_shuffle_files(spark):
    """Each step's shuffle files are gone when its rows are written, whatever the driver's heap."""

    def shuffles():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return set(re.findall(r"shuffle_(\d+)_", manager.getAllFiles().mkString(" ")))

    before = shuffles()
    docs = spark.createDataFrame(_family(random.Random(10), 30, 100), "doc_id long, text string")
    found = near_copies(docs, links=True)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() <= before
    assert spark.conf.get(FREE_CONF, None) is None
    assert found.where("component_id = 0").count() == 30


def test_quality_edges(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (8, None), (9, 7)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    rows = score_quality(clashing, model, ["doc_id"]).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    assert score_quality(empty, model, ["doc_id"]).count() == 0
    unlabelled = fit_quality(odd, labels.limit(0))
    assert isinstance(unlabelled, Model) and {r.score for r in score_quality(odd, unlabelled, []).collect()} == {0.5}


def test_components_of_paths_and_stars(spark):
    from layerflow.llm.common import components

    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 150)] + [(200, 200), (300, None)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 150)}, 200: 200}
