"""Collocations: phrases whose words stand together far more often than their parts would.

Each shard of texts sorts its n-grams and builds a count transducer from them. The transducers
are cut at common bounds into ranges of prefixes, those of a range are united with their weights
summed, and the parts of each candidate are looked up by composing the automaton of the parts
asked for with the counts of their range.

Which n-grams can be frequent is found first, by counts of hash buckets over all texts: a bucket
counts at least as much as each n-gram in it, so nothing frequent is lost.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import query, table
from layerflow.llm.transducers import Builder, Transducer, compose, union
from layerflow.session import cut

#: Fixed values of the contract: longest phrase, least occurrences, rows for each language, the
#: name of a null language, and the factor of the score.
LONGEST, LEAST, BEST, NO_LANG, FACTOR = 5, 100, 2000, "und", 1000

#: A filter has so many buckets, a bit each (16 MB), whatever the input. With more n-grams than
#: about a hundred times that it lets most pass: then raise it.
FILTER_BITS = 27
#: Parts of a filter that are summed on their own.
SLOTS = 1024
#: A shard: so many words of one task are counted at once.
SHARD_WORDS = 4_000_000
#: Prefix ranges: their bounds come from at most so many sampled pairs of words.
SAMPLE_PAIRS = 20_000
#: Shards unite so many automata of a range at once.
UNITE = 64

#: A-Z to a-z, a tab to a blank, and the characters between pieces to a byte that no UTF-8 has.
BREAK = 0xFF
_CHARS = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c == 9 else BREAK if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256)
)
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Numbers(dict):
    """A number for each new key; the break between pieces is 0."""

    def __init__(self):
        super().__init__({bytes([BREAK]): 0})

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


class Shard:
    """The words of one language in a shard, in text order, with breaks between pieces."""

    def __init__(self, lang: str, ids: np.ndarray, words: list[bytes], crcs: np.ndarray, filters: dict[int, np.ndarray]):
        # words ascend and are numbered from 1; 0 is a break
        self.lang, self.ids, self.words, self.filters = lang, ids, words, filters
        self._hash = _mix(crcs[ids] ^ (_U(zlib.crc32(lang.encode())) << _U(32)))
        self._crcs = crcs
        self.alive = ids > 0
        self.size = 1

    def buckets(self) -> np.ndarray:
        """The bucket of the n-gram at each place that is alive."""
        return (self._hash[self.alive] >> _U(64 - FILTER_BITS)).astype(np.int64)

    def sift(self) -> None:
        """Leave out what the filter of this size shows to be rare."""
        bits = self.filters.get(self.size)
        if bits is not None:
            at = np.flatnonzero(self.alive)
            bucket = self.buckets()
            self.alive[at] = (bits[bucket >> 3] >> (bucket & 7)) & 1

    def longer(self) -> None:
        """One word more: an n-gram lives if both n-grams inside it do."""
        n = self.size
        self.alive = self.alive[:-1] & self.alive[1:]
        self._hash = _mix(self._hash[:-1] * _U(0x9E3779B97F4A7C15) + self._crcs[self.ids[n:]])
        self.size = n + 1


def _shards(batches: Iterator[pa.RecordBatch], filters: dict[int, np.ndarray]) -> Iterator[Shard]:
    numbers, parts, held = _Numbers(), {}, 0

    def out() -> Iterator[Shard]:
        words = sorted(w for w in numbers if numbers[w])
        rank = np.zeros(len(numbers), dtype=np.int64)
        for new, word in enumerate(words, 1):
            rank[numbers[word]] = new
        crcs = np.array([0, *map(zlib.crc32, words)], dtype=np.uint64)
        for lang in sorted(parts):
            yield Shard(lang, rank[np.concatenate(parts[lang])], words, crcs, filters)

    gap = bytes([32, BREAK, 32])
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            # only blanks split: other white space was made a break, and the rest are letters here
            tokens = data.translate(_CHARS).replace(bytes([BREAK]), gap).split()
            if not tokens:
                continue
            tokens.append(bytes([BREAK]))
            parts.setdefault(NO_LANG if lang is None else lang, []).append(
                np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
            )
            held += len(tokens)
            if held >= SHARD_WORDS:
                yield from out()
                numbers, parts, held = _Numbers(), {}, 0
    if held:
        yield from out()


_SCANNED = "level int, slot int, data binary, lang string, n long, first binary, second binary, draw long"


def _scanned(**columns: list) -> pa.RecordBatch:
    kinds = {"level": pa.int32(), "slot": pa.int32(), "lang": pa.string(), "n": pa.int64(), "draw": pa.int64()}
    names = ["level", "slot", "data", "lang", "n", "first", "second", "draw"]
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * rows), kinds.get(c, pa.binary())) for c in names], names=names
    )


def _bucket_counts(shard: Shard, least: int) -> pa.RecordBatch:
    """The filter's counts of this shard by slot: bucket numbers, and counts up to ``least``."""
    bucket, n = np.unique(shard.buckets(), return_counts=True)
    width = (1 << FILTER_BITS) // SLOTS
    bounds = np.searchsorted(bucket, np.arange(SLOTS + 1) * width)
    slots = np.flatnonzero(np.diff(bounds)).tolist()
    small = np.minimum(n, least).astype("<u4")
    data = [(bucket[bounds[s] : bounds[s + 1]] - s * width).astype("<u4").tobytes() + small[bounds[s] : bounds[s + 1]].tobytes() for s in slots]
    return _scanned(level=[shard.size] * len(slots), slot=slots, data=data)


def _filters(scanned: DataFrame, least: int) -> dict[int, np.ndarray]:
    """Buckets counted ``least`` times at least, as bits, for each size of n-gram."""
    width = (1 << FILTER_BITS) // SLOTS

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> pa.RecordBatch:
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return _scanned(level=[key[0]], slot=[key[1]], data=[bits])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("level", "slot", "data"))
            for level, slot, data in zip(*columns):
                if (level, slot) != key:
                    if key is not None:
                        yield out()
                    key, total = (level, slot), np.zeros(width, dtype=np.int64)
                values = np.frombuffer(data, dtype="<u4")
                total[values[: len(values) // 2]] += values[len(values) // 2 :]
        if key is not None:
            yield out()

    rows = scanned.where("slot is not null").repartition("level", "slot").sortWithinPartitions("level", "slot")
    found: dict[int, np.ndarray] = {}
    step = width // 8
    for row in rows.mapInArrow(summed, _SCANNED).select("level", "slot", "data").collect():
        bits = found.setdefault(row.level, np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8))
        bits[row.slot * step : (row.slot + 1) * step] = np.frombuffer(row.data, dtype=np.uint8)
    return found


def sorted_grams(shard: Shard, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct n-grams of the shard up to ``longest`` words that the filters let pass, as
    rows of word numbers filled up with 0, in ascending order, and their counts."""
    rows, counts, ranks, table = [], [], None, None
    base = shard.ids.astype(np.int64)
    for n in range(1, longest + 1):
        if n > 1:
            shard.longer()
        shard.sift()
        at = np.flatnonzero(shard.alive)
        if not len(at):
            break
        if n == 1:
            key, inverse, count = np.unique(base[at], return_inverse=True, return_counts=True)
            table = np.zeros((len(key), longest), dtype=np.int32)
            table[:, 0] = key
        else:
            label = base[at + n - 1]
            key, inverse, count = np.unique(ranks[at] * (len(shard.words) + 1) + label, return_inverse=True, return_counts=True)
            table = table[key // (len(shard.words) + 1)]
            table[:, n - 1] = key % (len(shard.words) + 1)
        ranks = np.full(len(shard.alive), -1, dtype=np.int64)
        ranks[at] = inverse
        rows.append(table)
        counts.append(count)
    if not rows:
        return np.zeros((0, longest), dtype=np.int32), np.zeros(0, dtype=np.int64)
    grams, count = np.concatenate(rows), np.concatenate(counts)
    order = np.lexsort(grams.T[::-1])
    return grams[order], count[order]


def _transducer(grams: np.ndarray, counts: np.ndarray, words: list[bytes]) -> Transducer:
    """The count transducer of sorted rows of word numbers."""
    same = np.zeros(grams.shape, dtype=bool)
    same[1:] = (grams[1:] == grams[:-1]) & (grams[1:] > 0)
    shared = np.cumprod(same, axis=1).sum(axis=1).tolist()
    sizes = (grams > 0).sum(axis=1).tolist()
    used, flat = np.unique(grams, return_inverse=True)
    flat = flat.reshape(grams.shape)
    if len(used) and used[0] == 0:
        used, flat = used[1:], flat - 1
    builder = Builder()
    for row, low, high, n in zip(flat.tolist(), shared, sizes, counts.tolist()):
        builder.add(low, row[low:high], n)
    return Transducer.of(builder, builder.finish(), [words[i - 1] for i in used.tolist()])


Bound = tuple[str, tuple[bytes, ...]]


def _pieces(shard: Shard, grams: np.ndarray, bounds: list[Bound]) -> Iterator[tuple[int, int, int]]:
    """(range, first row, last row): the sorted rows cut at the bounds."""
    words = shard.words
    low, high = bisect.bisect_left(bounds, (shard.lang, ())), bisect.bisect_left(bounds, (shard.lang + "\0", ()))

    def name(i: int) -> tuple[bytes, ...]:
        return tuple(words[k - 1] for k in grams[i].tolist() if k)

    starts = [bisect.bisect_left(range(len(grams)), bound, key=name) for _, bound in bounds[low:high]]
    for k, (a, b) in enumerate(zip([0, *starts], [*starts, len(grams)])):
        if b > a:
            yield low + k, a, b


def _bounds(sample: list[tuple[str, bytes, bytes]], ranges: int) -> list[Bound]:
    """Bounds that part the sampled pairs of words evenly."""
    held = sorted((lang, (a, b)) for lang, a, b in sample)
    step = max(1, len(held) // max(1, ranges))
    return sorted(set(held[step::step]))


_UNITED = "range int, lang string, data binary"


def _united(least: int):
    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One transducer for each range and language; rows come sorted by both."""
        key, waiting = None, []

        def out() -> pa.RecordBatch:
            made = union(waiting, least)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.string()), pa.array([made.to_bytes()], pa.binary())],
                names=["range", "lang", "data"],
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("range", "lang", "data"))
            for number, lang, data in zip(*columns):
                if (number, lang) != key:
                    if key is not None:
                        yield out()
                    key, waiting = (number, lang), []
                waiting.append(Transducer.from_bytes(data))
                if len(waiting) >= UNITE:
                    waiting = [union(waiting)]
        if key is not None:
            yield out()

    return unite


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, a): all sequences of united transducers."""
    for batch in batches:
        for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data").to_pylist()):
            found = [(b" ".join(gram).decode(), len(gram), n) for gram, n in Transducer.from_bytes(data).items()]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                names=["lang", "phrase", "words", "a"],
            )


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, part, f): the parts asked for composed with the counts of their range. Rows come
    sorted by range, language and, within these, the transducer before the parts."""
    counts, asked, lang_now = None, [], None

    def out() -> Iterator[pa.RecordBatch]:
        if counts is None or not asked:
            return
        wanted = Transducer.from_counts({tuple(part.encode().split(b" ")): 1 for part in asked})
        found = [(b" ".join(gram).decode(), n) for gram, n in compose(wanted, counts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang_now] * len(found), pa.string()), pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())],
            names=["lang", "part", "f"],
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("lang", "data", "part"))
        for lang, data, part in zip(*columns):
            if data is not None:
                yield from out()
                counts, asked, lang_now = Transducer.from_bytes(data), [], lang
            else:
                asked.append(part)
                if len(asked) >= 100_000:
                    yield from out()
                    asked = []
    yield from out()


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, list[Bound]]:
    """The united count transducers (range, lang, data) of all phrases of 1 to ``longest`` words
    with ``least`` occurrences, the words of each language (lang, n), and the ranges' bounds."""
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def first_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, {}):
            yield _bucket_counts(shard, least)
            shard.longer()
            yield _bucket_counts(shard, least)

    known = _filters(texts.mapInArrow(first_scan, _SCANNED), least)
    sent = spark.sparkContext.broadcast(known)

    def second_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in enumerate(_shards(batches, sent.value)):
            yield _scanned(lang=[shard.lang], n=[int(shard.alive.sum())])
            shard.sift()
            shard.longer()
            shard.sift()
            # one of 64 different pairs of words, chosen by hash
            at = np.flatnonzero(shard.alive)
            _, once = np.unique(shard._hash[at], return_index=True)
            at = at[once]
            at = at[shard._hash[at] % _U(64) == _U(number % 64)]
            if len(at):
                names = [[shard.words[k - 1] for k in shard.ids[at + j].tolist()] for j in (0, 1)]
                draw = _mix(shard._hash[at] + _U(number)).astype(np.int64)
                yield _scanned(lang=[shard.lang] * len(at), first=names[0], second=names[1], draw=draw)
            shard.longer()
            yield _bucket_counts(shard, least)

    scanned = cut(texts.mapInArrow(second_scan, _SCANNED))
    known = {**known, **_filters(scanned, least)}
    pairs = scanned.where("draw is not null")
    drawn = pairs.orderBy("draw", "lang", "first", "second").limit(SAMPLE_PAIRS).collect()
    # about 40,000 different n-grams of a shard for each range
    ranges = min(SAMPLE_PAIRS // 4, 1 + pairs.count() * 64 // 40_000)
    bounds = _bounds([(r.lang, bytes(r.first), bytes(r.second)) for r in drawn], ranges)
    sent = spark.sparkContext.broadcast(known)
    limits = spark.sparkContext.broadcast(bounds)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, sent.value):
            grams, counts = sorted_grams(shard, longest)
            made = [(k, _transducer(grams[a:b], counts[a:b], shard.words).to_bytes()) for k, a, b in _pieces(shard, grams, limits.value)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in made], pa.int32()), pa.array([shard.lang] * len(made), pa.string()), pa.array([d for _, d in made], pa.binary())],
                names=["range", "lang", "data"],
            )

    dealt = texts.mapInArrow(build, _UNITED).repartition("range", "lang").sortWithinPartitions("range", "lang")
    united = cut(dealt.mapInArrow(_united(least), _UNITED))
    totals = scanned.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    return united, totals, bounds


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, factor: int = FACTOR) -> DataFrame:
    """Each language's ``best`` phrases: (lang, rank, phrase, a, l, r, n, score).

    A candidate has 2 to ``longest`` words and ``least`` occurrences (a). Each cut after its
    first k words gives the counts l and r of both parts and floor(factor * a * n / (l * r)),
    with n all words of the language; the lowest counts, the smallest k among equals. A phrase
    inside a longer candidate that occurs as often is left out. Order: score and a descending,
    phrase ascending by its UTF-8 bytes.

    ``docs`` has text and lang; further columns are ignored. Null texts have no words, a null
    lang counts as ``und``, repeated rows count again, and an empty table gives an empty table.
    Numbers are exact: products are decimals of 38 digits.
    """
    united, totals, bounds = phrase_counts(docs, least, longest)
    spark = docs.sparkSession
    counted = cut(united.mapInArrow(_listed, "lang string, phrase string, words int, a long"))
    candidates = counted.where("words > 1").select("lang", "phrase", "words", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).withColumns({
        "head": F.expr("substring_index(phrase, ' ', k)"),
        "rest": F.expr("substring_index(phrase, ' ', k - words)"),
    })
    asked = cuts.select("lang", F.explode(F.array("head", "rest")).alias("part")).distinct()
    limits = spark.sparkContext.broadcast(bounds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = batch.column("lang").to_pylist(), batch.column("part").to_pylist()
            at = [bisect.bisect_right(limits.value, (lang, tuple(part.encode().split(b" ")))) for lang, part in zip(langs, parts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), batch.column("lang"), pa.array([None] * len(at), pa.binary()), batch.column("part")],
                names=["range", "lang", "data", "part"],
            )

    requests = asked.mapInArrow(placed, "range int, lang string, data binary, part string")
    both = united.withColumn("part", F.lit(None).cast("string")).unionByName(requests)
    met = both.repartition("range", "lang").sortWithinPartitions("range", "lang", F.col("part").asc_nulls_first())
    found = cut(met.mapInArrow(_looked_up, "lang string, part string, f long"))
    heads = found.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    rests = found.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    measured = cut(cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]))
    inside = measured.where("k = words - 1 and words > 2 and 100 * a >= 100 * l").select("lang", F.col("head").alias("phrase"))
    inside = inside.unionByName(
        measured.where("k = 1 and words > 2 and 100 * a >= 100 * r").select("lang", F.col("rest").alias("phrase"))
    ).distinct()
    exact = (
        f"(cast({int(factor)} as decimal(10,0)) * cast(a as decimal(19,0)) * cast(n as decimal(19,0)))"
        " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    )
    scored = (
        measured.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
        .withColumn("score", F.expr(exact).cast("long"))
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("low"))
        .join(inside, ["lang", "phrase"], "left_anti")
        .select("lang", "phrase", *[F.col(f"low.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of 64 parts first, so that no task ranks all phrases of a language
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: Phrases as text: parts are joined by blanks, and cut at k blanks.
SQL = r"""
WITH words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
  )
),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, i, unnest(range(1, 6)) AS size FROM starts)
  WHERE i + size - 1 <= len(w)
),
counts AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, size, phrase, f AS a, k,
         array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM counts WHERE size > 1)
),
inside AS (
  SELECT DISTINCT c.lang, p.phrase
  FROM (SELECT lang, size, phrase, f, unnest(range(1, size + 1)) AS i FROM counts WHERE size > 2) c,
       LATERAL (SELECT unnest(range(2, c.size)) AS len) s,
       LATERAL (SELECT array_to_string(string_split(c.phrase, ' ')[c.i:c.i + s.len - 1], ' ') AS phrase) q
  JOIN counts p ON p.lang = c.lang AND p.phrase = q.phrase AND p.size = s.len
  WHERE c.i + s.len - 1 <= c.size AND 100 * c.f >= 100 * p.f
),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n, c.k,
         ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
  JOIN counts t ON t.lang = c.lang AND t.phrase = c.rest
  JOIN totals ON totals.lang = c.lang
),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest ANTI JOIN inside USING (lang, phrase)
QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of each language over all documents."""
    return collocations(table(spark, sf_dir, "documents"))
