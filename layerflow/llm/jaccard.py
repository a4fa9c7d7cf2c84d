"""Joins of texts by the Jaccard similarity of their word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import components, query, small, table, text_or_empty
from layerflow.session import cut, shuffles_freed

SHINGLE = 5
#: Two texts link when SIMILAR[1] * shared shingles >= SIMILAR[0] * all their shingles.
SIMILAR = (3, 4)
#: Orders of the shingles, besides the one by rarity, under which two texts must share one of
#: their first shingles before they are compared.
ORDERS = 2
#: Texts and shingles of one side of a tile: what one task compares at a time.
TILE_TEXTS, TILE_SHINGLES = 256, 1 << 18
#: About what a round of tiles sends at most, as a share of the shingles of all rows. A text of a large
#: unit goes into many tiles, so all tiles at once would need disk by the square of the unit.
ROUND = 0.5
#: Counts of a shingle's texts stop here; more frequent ones are all the most frequent.
MOST = 1 << 20
#: Bytes of text that are hashed at a time.
BATCH = 1 << 17
#: Keys of texts that a scan remembers, so as to send copies once.
REMEMBERED = 1 << 18
#: Shingles below this hash come first in the order by rarity: three eighths of all.
FIRST = -(1 << 63) + 3 * (1 << 61)
#: Bits of the filter by which a scan leaves out texts without a block: 16 MB, whatever the
#: number of texts. Each text sets three, at these shifts of its hash.
FILTER_BITS, FILTER_SHIFTS = 27, (0, 18, 37)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_SEPARATES = np.zeros(256, dtype=bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _A)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]  # A-Z count as a-z
_SEEDS = np.arange(1, ORDERS + 1, dtype=np.uint64) * _A
_FACTORS = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _C) | np.uint64(1)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and 64-bit hashes of the words in an array of bytes."""
    inside = ~_SEPARATES[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, np.zeros(0, np.uint64)
    size = end - begin
    places = np.flatnonzero(inside)
    within = places - np.repeat(begin, size)
    powers = np.full(int(size.max()), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    values = _BYTES[data[places]] * powers[within]
    sums = np.add.reduceat(values, np.concatenate([[0], np.cumsum(size)[:-1]]))
    return begin, _mix(sums + size.astype(np.uint64) * _A)


def _long_words(data: bytes) -> np.ndarray:
    """The hashes of a long text's words, by stretches that end between words."""
    out, at = [], 0
    while at < len(data):
        size = BATCH
        while True:
            part = np.frombuffer(data[at : at + size], dtype=np.uint8)
            if at + size >= len(data):
                break
            gaps = np.flatnonzero(_SEPARATES[part])
            if len(gaps):
                part = part[: gaps[-1] + 1]
                break
            size *= 2  # one word longer than the stretch
        out.append(_word_hashes(part)[1])
        at += len(part)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(words: np.ndarray, doc: np.ndarray, docs: int) -> list[np.ndarray]:
    """The shingle set of each text, sorted, from its words' hashes in order."""
    many = len(words) - SHINGLE + 1
    whole = np.flatnonzero(doc[: max(many, 0)] == doc[SHINGLE - 1 :]) if many > 0 else np.zeros(0, int)
    sums = np.zeros(len(whole), np.uint64)
    for k in range(SHINGLE):
        sums += words[whole + k] * _FACTORS[k]
    hashes, owner = _mix(sums), doc[whole]
    counts = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    few = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        has = counts[short] > k
        few[has] += words[first[short[has]] + k] * _FACTORS[k]
    few = _mix(few ^ (counts[short].astype(np.uint64) * _B))
    hashes, owner = np.concatenate([hashes, few]).view(np.int64), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    cuts = np.searchsorted(owner, np.arange(docs + 1))
    return [hashes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """The set of each text, as sorted 64-bit hashes of its distinct 5-word shingles. Words are
    runs of bytes other than blank, tab and line breaks, A-Z taken as a-z. A text with fewer
    words has its whole sequence as one shingle, one without words the empty set."""
    some: list[bytes] = []
    size = 0

    def done() -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(some), dtype=np.uint8)
        begin, words = _word_hashes(data)
        starts = np.cumsum([0, *[len(d) + 1 for d in some]])
        doc = np.searchsorted(starts, begin, side="right") - 1
        yield from _sets(words, doc, len(some))

    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if some and size + len(data) > BATCH:
            yield from done()
            some, size = [], 0
        if len(data) > BATCH:
            words = _long_words(data)
            yield from _sets(words, np.zeros(len(words), dtype=np.int64), 1)
        else:
            some.append(data)
            size += len(data)
    if some:
        yield from done()


def _key(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def prefix_size(n: int | np.ndarray) -> int | np.ndarray:
    """How many first shingles, in any order, must meet those of every similar set."""
    return n - (SIMILAR[0] * n + SIMILAR[1] - 1) // SIMILAR[1] + 1


def shingle_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, set, text, n_first): ``set`` stands for the set of shingles, ``text`` is
    its first half as a number, and ``n_first`` is how many of the shingles are below FIRST. An
    empty set has no names."""

    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(s), _key(s) if len(s) else None, int(np.searchsorted(s, FIRST))) for s in shingle_sets(list(batch))]
            yield pd.DataFrame(rows, columns=["n", "set", "n_first"])

    run = F.pandas_udf(keys, "n long, set binary, n_first long")
    rows = docs.select(F.col(key), run(text_or_empty()).alias("found"))
    whole = F.conv(F.hex(F.substr("found.set", F.lit(1), F.lit(8))), 16, -10).cast("long")
    return rows.select(
        key, F.col("found.n").alias("n_shingles"), F.col("found.set").alias("set"), whole.alias("text"), F.col("found.n_first").alias("n_first")
    )


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, text) for the shingles of each text below FIRST, or as many of the lowest as a
    prefix has. Copies within a task are sent once."""
    seen: set[int] = set()
    for batch in batches:
        shingles, texts, held = [], [], 0
        for s in shingle_sets(batch.column(0).to_pylist()):
            if not len(s):
                continue
            text = _short(_key(s))
            if text in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(text)
            sent = max(int(np.searchsorted(s, FIRST)), prefix_size(len(s)))
            shingles.append(s[:sent])
            texts.append(np.full(sent, text))
            held += sent
            if held > MOST:
                yield _batch(shingle=np.concatenate(shingles), text=np.concatenate(texts))
                shingles, texts, held = [], [], 0
        if held:
            yield _batch(shingle=np.concatenate(shingles), text=np.concatenate(texts))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns.values()], names=list(columns))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that two texts or more have, with the number of texts. The input is
    sorted by shingle and text; only the last shingle's rows are held from batch to batch, and
    of a shingle with MOST texts only the number."""
    held: list[np.ndarray] | None = None
    full: int | None = None

    def count(shingle: np.ndarray, text: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(shingle):
            return
        new = np.ones(len(shingle), dtype=bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
        shingle, text = shingle[new], text[new]
        starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        runs = np.diff(np.append(starts, len(shingle)))
        texts = np.repeat(np.minimum(runs, MOST), runs)
        if full is not None:
            texts[shingle == full] = MOST
        keep = texts > 1
        if keep.any():
            yield _batch(shingle=shingle[keep], text=text[keep], texts=texts[keep])

    for batch in batches:
        columns = [np.asarray(c) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held, columns)]
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        yield from count(*[c[:last] for c in columns])
        held = [c[last:] for c in columns]
        if len(held[0]) >= MOST or held[0][0] == full:
            full = int(held[0][0])
            yield from count(*held)
            held = None
    if held is not None:
        yield from count(*held)


def prefixes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(shingle, text, n): the first shingles of each text by rarity that another one has.
    ``rows`` are the texts' sizes as ``shingle_keys`` gives them.

    The order puts three eighths of all shingles first, chosen by hash: those by the number of
    texts that have them and then by hash; the others follow by hash alone. So shingles of
    passages that many texts share come late. The numbers are counted over all texts. Sets
    with a similarity of 3/4 share one of their first n - ceil(3 n / 4) + 1 shingles. The shared
    ones are written, so that the shuffle of all of them is over before they are ranked.
    """
    sent = docs.select(text_or_empty().alias("text")).mapInArrow(_spread, "shingle long, text long")
    dealt = sent.repartition("shingle").sortWithinPartitions("shingle", "text")
    shared = cut(dealt.mapInArrow(_shared, "shingle long, text long, texts long"))
    sizes = rows.where("text is not null").groupBy("text").agg(F.max("n_shingles").alias("n"), F.max("n_first").alias("n_first"))
    early, own = F.col("shingle") < FIRST, Window.partitionBy("text")
    ranked = shared.join(sizes, "text").select(
        "shingle",
        "text",
        "n",
        (F.col("n_first") - F.count(F.when(early, 1)).over(own)).alias("alone"),
        F.row_number().over(own.orderBy(~early, "texts", "shingle")).alias("place"),
    )
    size = F.col("n") - F.floor((F.col("n") * SIMILAR[0] + SIMILAR[1] - 1) / SIMILAR[1]) + 1
    return ranked.where(~early | (F.col("place") + F.col("alone") <= size)).select("shingle", "text", "n")


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _together(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share: products of incidence matrices, in slices."""
    shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = shingles[1:] != shingles[:-1]
    place = np.cumsum(new) - 1
    several = np.bincount(place) > 1
    keep = several[place]
    place, owner = (np.cumsum(several) - 1)[place[keep]], owner[keep]
    out = np.zeros((len(sets), len(sets)))
    slices = np.searchsorted(place, np.arange(0, (place[-1] if len(place) else -1) + 1 + 4096, 4096))
    for k, (a, b) in enumerate(zip(slices[:-1], slices[1:])):
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[a:b], place[a:b] - 4096 * k] = 1.0
        out += part @ part.T
    return out


def _candidates(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The pairs (row above column) of the left and the right side of a tile whose sizes allow
    the similarity and that share a prefix shingle under each of several orders by hash."""
    n = np.array([len(s) for s in sets])
    few, many = np.minimum.outer(n, n), np.maximum.outer(n, n)
    mask = (SIMILAR[1] * few >= SIMILAR[0] * many) & np.logical_and.outer(left, right)
    mask = np.triu(mask | mask.T, 1)
    some = len(sets) > 8
    for order in range(ORDERS):
        if not mask.any():
            break
        first = []
        for s in sets:
            rank = _mix(s.view(np.uint64) ^ _SEEDS[order])
            p = int(prefix_size(len(s)))
            first.append(s[np.argpartition(rank, p - 1)[:p]] if p < len(s) else s)
        if some:
            mask &= _together(first) > 0
        else:
            for a, b in np.argwhere(mask):
                mask[a, b] = len(np.intersect1d(first[a], first[b], assume_unique=True)) > 0
    return mask


def _similar(shared: int | np.ndarray, a: int | np.ndarray, b: int | np.ndarray) -> bool | np.ndarray:
    return SIMILAR[1] * shared >= SIMILAR[0] * (a + b - shared)


def links_in_tile(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between sets of the left and of the right side of a tile that connect what the
    links of the tile connect. Candidates that are not connected yet are compared exactly."""
    pairs, forest, out = np.argwhere(_candidates(sets, left, right)), _Forest(len(sets)), []
    both = _together(sets) if len(pairs) > 4 * len(sets) else None
    for a, b in pairs:
        a, b = int(a), int(b)
        if forest.top(a) == forest.top(b):
            continue
        shared = int(both[a, b]) if both is not None else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if _similar(shared, len(sets[a]), len(sets[b])) and forest.join(a, b):
            out.append((a, b))
    return out


def all_links_in_tile(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All links between sets of the left and of the right side of a tile, as a matrix (row
    above column). Every candidate is compared exactly."""
    mask = _candidates(sets, left, right)
    pairs = np.argwhere(mask)
    if len(pairs) > 4 * len(sets):
        n = np.array([len(s) for s in sets])
        return mask & _similar(_together(sets), n[:, None], n[None, :])
    for a, b in pairs:
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        mask[a, b] = _similar(shared, len(sets[a]), len(sets[b]))
    return mask


def _connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect each tile; the rows of a tile come together."""
    for tile in _tiles(batches):
        found = links_in_tile(list(shingle_sets(tile["body"])), tile["left"], tile["right"])
        if found:
            yield pd.DataFrame({"a": [tile["set"][a] for a, _ in found], "b": [tile["set"][b] for _, b in found]})


def _count_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links that connect each tile, and a row (set, null, links) for each linked set of it with
    the number of rows it links with. A pair that meets in several units counts in the first
    of them."""
    for tile in _tiles(batches):
        linked = all_links_in_tile(list(shingle_sets(tile["body"])), tile["left"], tile["right"])
        if not linked.any():
            continue
        forest = _Forest(len(linked))
        found = [(int(a), int(b)) for a, b in np.argwhere(linked) if forest.join(int(a), int(b))]
        if tile["units"][0] is not None:
            linked &= _together([u[u < tile["unit"]] for u in (np.asarray(u, dtype=np.int64) for u in tile["units"])]) == 0
        links = (linked | linked.T) @ np.array(tile["copies"], dtype=np.int64)
        some = np.flatnonzero(links)
        names = tile["set"]
        yield pd.DataFrame(
            {
                "a": [names[a] for a, _ in found] + [names[i] for i in some],
                "b": [names[b] for _, b in found] + [None] * len(some),
                "links": [0] * len(found) + [int(links[i]) for i in some],
            }
        )


def _tiles(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """The tiles of more than one set, from rows that come together and sorted by set."""
    now: tuple | None = None
    tile: dict = {}

    def done() -> Iterator[dict]:
        if now is not None and len(tile["set"]) > 1:
            sides = np.array(tile["chunk"])
            yield {**tile, "unit": now[0], "left": sides == now[1], "right": sides == now[2]}

    for batch in batches:
        names = list(batch.columns[3:])
        for unit, one, two, *rest in batch.itertuples(index=False):
            if (unit, one, two) != now:
                yield from done()
                now, tile = (unit, one, two), {c: [] for c in names}
            row = dict(zip(names, rest))
            if tile["set"] and tile["set"][-1] == row["set"]:
                continue
            for c, value in row.items():
                tile[c].append(value)
    yield from done()


def _filter(members: DataFrame) -> np.ndarray:
    """A Bloom filter of the column ``text``: words of 64 bits."""
    bits = [F.call_function("shiftrightunsigned", F.col("text"), F.lit(by)).bitwiseAND((1 << FILTER_BITS) - 1) for by in FILTER_SHIFTS]
    spots = members.select(F.explode(F.array(*bits)).alias("bit"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))
    found = spots.groupBy(F.call_function("shiftright", F.col("bit"), F.lit(6)).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out


def _members(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(text, set, body) of the texts in ``members``, and of few others: the scan leaves out
    what a filter of fixed size tells apart. Each task sends copies once."""
    wanted = docs.sparkSession.sparkContext.broadcast(_filter(members))

    def has(text: int) -> bool:
        bits = [((text & 0xFFFFFFFFFFFFFFFF) >> by) & ((1 << FILTER_BITS) - 1) for by in FILTER_SHIFTS]
        return all((int(wanted.value[b >> 6]) >> (b & 63)) & 1 for b in bits)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        schema = pa.schema([("text", pa.int64()), ("set", pa.binary()), ("body", pa.string())])
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            bodies = batch.column(0).to_pylist()
            for body, s in zip(bodies, shingle_sets(bodies)):
                key = _key(s) if len(s) else b""
                if not key or key in seen or not has(_short(key)):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(key)
                for column, value in zip(rows, (_short(key), key, body)):
                    column.append(value)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema)], schema=schema)

    return docs.select(text_or_empty().alias("text")).mapInArrow(pick, "text long, set binary, body string")


def _chunks(texts: str, shingles: str) -> Column:
    """Chunks of a unit, so that two of them make a tile of bounded size."""
    return F.greatest(F.ceil(F.greatest(F.col(texts) / TILE_TEXTS, F.col(shingles) / TILE_SHINGLES)), F.lit(1)).cast("long")


def compared_together(prefix: DataFrame) -> DataFrame:
    """The units within which texts are compared: (text, n, unit, chunks, several, chunk), from the
    prefixes (shingle, text, n). ``several``: the text's units are groups, of which it may have more.

    The texts of a prefix shingle are a group; groups of the same texts, as the shingles of one
    passage make them, are one. Groups that overlap form a block. A block is a unit if its texts
    are sent less often so: families of near copies, whose groups are nearly all the same, and
    blocks of one chunk. Otherwise each of its groups is a unit: texts that are chained by
    passages meet only those with which they share a prefix shingle. Either way each two
    texts that share one meet in a unit.
    """
    name = F.xxhash64(F.lit("texts"), "text")
    groups = prefix.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"), F.min("text").alias("lead"),
        F.bit_xor(name).alias("x"), F.sum(F.xxhash64("text").cast("decimal(20,0)")).alias("s"),
    )
    groups = groups.where("texts > 1").groupBy("texts", "shingles", "lead", "x", "s").agg(F.min("shingle").alias("shingle"))
    members = cut(prefix.select("shingle", "text", "n").join(groups.select("shingle", "lead", "texts", "shingles"), "shingle"))
    linked = components(members.select(F.col("text").alias("a"), F.col("lead").alias("b")).distinct())
    blocks = linked.select(F.col("node").alias("text"), F.col("root").alias("block"))
    sizes = members.select("text", "n").distinct()
    blocks = cut(blocks.join(sizes, "text"))
    shape = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("shingles"))
    shape = shape.select("block", "texts", _chunks("texts", "shingles").alias("chunks"))
    # how often texts are sent if each group is a unit
    own = members.select("shingle", "lead", "texts", _chunks("texts", "shingles").alias("chunks")).distinct()
    sent = own.join(blocks.select(F.col("text").alias("lead"), "block"), "lead").groupBy("block").agg(
        F.sum(F.col("texts") * F.col("chunks")).alias("sent")
    )
    shape = cut(shape.join(sent, "block").select("block", "chunks", (F.col("texts") * F.col("chunks") <= F.col("sent")).alias("whole")))
    whole = blocks.join(shape.where("whole"), "block").select(
        "text", "n", F.col("block").alias("unit"), "chunks", F.lit(False).alias("several")
    )
    chained = shape.where("not whole").select("block")
    apart = members.join(blocks.join(chained, "block").select(F.col("text").alias("lead")), "lead").select(
        "text", "n", F.xxhash64(F.lit("group"), "shingle").alias("unit"), _chunks("texts", "shingles").alias("chunks"), F.lit(True).alias("several")
    )
    both = whole.unionByName(apart)
    return both.withColumn("chunks", F.col("chunks").cast("int")).withColumn("chunk", F.pmod(F.xxhash64("text"), F.col("chunks")).cast("int"))


def _counted(placed: DataFrame, rows: DataFrame) -> DataFrame:
    """``placed`` with what counting links needs: how many rows each set of the text's name has
    (``same``), and the units of a text that is in several (``units``, no more than its prefix)."""
    same = rows.where("set is not null").groupBy("text", "set").agg(F.count(F.lit(1)).alias("copies"))
    same = same.groupBy("text").agg(F.collect_list(F.struct("set", "copies")).alias("same"))
    units = placed.where("several").groupBy("text").agg(F.collect_set("unit").alias("units"))
    return placed.join(same, "text").join(units, "text", "left")


def _rounds(placed: DataFrame, rows: DataFrame) -> int:
    """In how many rounds the tiles are compared, so that each sends about ROUND at most."""
    sent = placed.agg(F.sum(F.col("n") * F.col("chunks"))).first()[0] or 0
    return max(1, math.ceil(sent / (ROUND * max(1, rows.agg(F.sum("n_shingles")).first()[0] or 0))))


def _tile_rows(bodies: DataFrame, placed: DataFrame, number: int, rounds: int, links: bool) -> DataFrame:
    """The rows of the tiles of one round, those of a tile together and sorted by set. A tile's
    round follows from the sum of its two chunks, which is the same for the texts of both."""
    at = F.col("chunk") + F.pmod(F.xxhash64("unit"), F.lit(rounds))
    first = F.pmod(F.lit(number) - at, F.lit(rounds)).cast("int")
    sets = bodies.join(placed.withColumn("first", first).where("first < chunks"), "text")
    tile = ["unit", "one", "two"]
    body = ["chunk", "set", "body"]
    if links:
        own = F.element_at(F.filter("same", lambda s: s["set"] == F.col("set")), 1)["copies"]
        sets = sets.withColumn("copies", own)
        body += ["copies", "units"]
    others = F.sequence(F.col("first"), F.col("chunks") - 1, F.lit(rounds))
    tiles = sets.withColumn("other", F.explode(others)).select(
        "unit", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), *body
    )
    return tiles.repartition(*tile).sortWithinPartitions(*tile, "set")


def _compared(docs: DataFrame, placed: DataFrame, rounds: int, links: bool) -> DataFrame:
    """What all tiles find, as ``_count_links`` or ``_connect`` give it. Each round's rows are
    sent and gone before the next one's; with several rounds the texts are written once."""
    bodies = _members(docs, placed).repartition("text").dropDuplicates(["text", "set"])
    if rounds > 1:
        bodies = cut(bodies)
    out = None
    for number in range(rounds):
        tiles = _tile_rows(bodies, placed, number, rounds, links)
        if links:
            found = cut(tiles.mapInPandas(_count_links, "a binary, b binary, links long"))
        else:
            found = cut(tiles.mapInPandas(_connect, "a binary, b binary"))
        out = found if out is None else out.unionByName(found)
    return out


def near_copies(docs: DataFrame, key: str = "doc_id", links: bool = False) -> DataFrame:
    """(key, n_shingles, set, component_id): the component of every row under links between
    texts with a similarity of 3/4 or more; its name is the smallest key in it. With ``links``
    also ``n_links``, the number of other rows it links with.

    1. Texts with equal sets are one from the start; copies are sent once by each task.
    2. Shingles are counted over all texts, and each text's prefix by rarity is taken. Texts
       that share a prefix shingle come into one unit (see ``compared_together``), so every link
       lies within a unit; no pairs are written.
    3. Units are compared in tiles of bounded size, each pair of chunks of a unit in a task of
       its own. In a tile, pairs must share prefixes under further orders, and are compared
       exactly unless they are connected already; only links that connect are written. With
       ``links`` all candidates are compared, and a set's number of links in the tile is
       written, weighed by the copies of the sets it links with. Tiles that would send the texts
       of large units too often at once are compared in rounds (see ``ROUND``).

    Every step's shuffle files are removed when the step is written.

    Null texts are empty; rows without words are components of their own and have no links. Rows
    with a null key can link others; a component's name is null only if all its keys are. Repeated
    rows get equal values, and each counts as a link of the others. No step gathers a block, a
    shingle's texts or the links anywhere.
    """
    with shuffles_freed(docs.sparkSession):
        rows = cut(shingle_keys(docs, key))
        placed = cut(compared_together(cut(prefixes(docs, rows))))
        rounds = _rounds(placed, rows)
        if links:
            placed = cut(_counted(placed, rows))
        compared = _compared(docs, placed, rounds, links)
        joined = components(compared.where("b is not null").select("a", "b"))

    smallest = rows.where("set is not null").groupBy("set").agg(F.min(key).alias("own"), F.count(F.lit(1)).alias("copies"))
    named = joined.select(F.col("node").alias("set"), "root").join(smallest, "set")
    names = named.groupBy("root").agg(F.min("own").alias("name"))
    found = smallest.join(named.join(names, "root").select("set", "name"), "set", "left")
    found = found.select("set", F.coalesce("name", "own").alias("component_id"), "copies")
    if links:
        others = compared.where("b is null").groupBy(F.col("a").alias("set")).agg(F.sum("links").alias("links"))
        found = found.join(others, "set", "left")
    out = rows.join(found, "set", "left")
    name = F.when(F.col("set").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id")
    if not links:
        return out.select(key, "n_shingles", "set", name)
    n_links = F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return out.select(key, "n_shingles", "set", name, n_links.cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each component of near copies: the one with the smallest key, null keys last.
    Rows without words stay, and all rows keep all columns. Of repeated rows with that key and
    set, the one with the smallest text by hash stays.

    The names of the rows that go are joined to the rows; if they are counted to be few they
    are broadcast and no text is shuffled.
    """
    found = near_copies(docs, key).where("set is not null")
    whole = F.coalesce(F.col("component_id").cast("string"), F.hex("set"))
    copies = cut(
        found.groupBy(F.col(key).alias("id"), "set").agg(F.count(F.lit(1)).alias("rows"), F.min(whole).alias("component"))
    )
    first = copies.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "set")).alias("first"))
    judged = copies.join(first, "component").select(
        "id", "set", ((F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("set") == F.col("first.set"))).alias("stays"), "rows"
    )
    named = cut(
        judged.where("not stays or rows > 1").select(F.col("id").alias("named_id"), F.col("set").alias("named_set"), "stays")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = shingle_keys(rows.select("row", F.col("row.text").alias("text")), "row").select("row", "set")
    same = F.col("row")[key].eqNullSafe(F.col("named_id")) & F.col("set").eqNullSafe(F.col("named_set"))
    met = keyed.join(small(named), same, "left")
    out = met.where(F.col("stays").isNull()).select("row.*")
    if named.where("stays").isEmpty():
        return out
    one = Window.partitionBy("named_id", "named_set").orderBy(F.xxhash64(F.col("row.text")))
    repeated = met.where("stays").withColumn("at", F.row_number().over(one)).where("at = 1").select("row.*")
    return out.unionByName(repeated)


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w),
s AS (SELECT DISTINCT doc_id, h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""


@query("op8_jaccard", OP8_SQL)
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of near copies among all documents, and how many others each links with."""
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"), links=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")
