"""Spelling variants: words one edit apart, found by pivotal grams.

All words rank their bigrams in one global order, rarest first. A word's prefix are its bigrams
up to the third in that order; two disjoint ones of them, chosen by dynamic programming for the
smallest total frequency, are its pivots. One edit leaves one of two disjoint pivots whole, and
that one is in the other word's prefix, at a place moved by at most one. The edit then lies on
one side of it, so the other side is the same in both words: pivots are looked up among the
prefixes together with the letters on that side. What is left on the edited side is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import query, table, text_or_empty
from layerflow.session import cut

#: Fixed values of the contract: shortest word, least occurrences, ratio of a form to its word,
#: and the divisor that decides which runs lose a letter.
LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 7, 2, 10, 31

#: Rows with one key that a task compares in memory; a key with more is dealt out once more, by
#: what verification compares.
MOST = 300_000
#: Rows that a task verifies at once, and words it counts before it passes them on.
STEP, COUNTED = 200_000, 500_000

_U = np.uint64
LEFT, RIGHT = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Letters:
    """The code points of many words in one array, with hashes of any prefix or suffix."""

    def __init__(self, words: list[str]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.codes)) - self.starts[self.owner]
        mixed = _mix(self.codes + _U(1))
        longest = int(self.sizes.max(initial=1))
        powers = np.ones(longest + 1, dtype=np.uint64)
        powers[1:] = _U(0x9E3779B97F4A7C15)
        powers = np.multiply.accumulate(powers)
        # sums over letters times a power of the place from the start, or from the end
        self._ahead = np.concatenate([[_U(0)], np.cumsum(mixed * powers[self.place])])
        self._behind = np.concatenate([[_U(0)], np.cumsum(mixed * powers[self.sizes[self.owner] - 1 - self.place])])

    def before(self, word: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the first ``end`` letters."""
        return _mix((self._ahead[self.starts[word] + end] - self._ahead[self.starts[word]]) ^ end.astype(np.uint64))

    def after(self, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of the letters from ``start``."""
        size = (self.sizes[word] - start).astype(np.uint64)
        return _mix((self._behind[self.ends[word]] - self._behind[self.starts[word] + start]) ^ (size << _U(32)))

    def grams(self) -> np.ndarray:
        """A 16-bit name for the bigram at each place, and -1 at a word's last place. Bigrams of
        letters below U+0100 have names of their own; others may share one."""
        out = np.full(len(self.codes), -1, dtype=np.int64)
        if len(out) > 1:
            pair = (self.codes[:-1] * _U(256) + self.codes[1:]) % _U(65536)
            out[:-1] = pair.astype(np.int64)
        out[self.ends[self.sizes > 0] - 1] = -1
        return out


def choose_pivots(places: list[int], costs: list[int]) -> tuple[int, int]:
    """Two disjoint places (two apart at least) of the smallest total cost, leftmost among
    equals. ``places`` ascend. One step per place: the best single place two or more before it,
    and the best pair so far."""
    best, pair, single, waiting = None, (-1, -1), None, []
    for place, cost in zip(places, costs):
        while waiting and waiting[0][0] <= place - 2:
            at, its = waiting.pop(0)
            if single is None or its < single[1]:
                single = (at, its)
        if single is not None and (best is None or single[1] + cost < best):
            best, pair = single[1] + cost, (single[0], place)
        waiting.append((place, cost))
    return pair


def signature_rows(words: list[str], frequency: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word number, place, pivot or not) of every prefix bigram of each word. ``frequency``
    has how often each of the 65536 bigram names occurs in all words. Words need four letters
    at least, as three bigrams hold two disjoint ones."""
    letters = Letters(words)
    grams = letters.grams()
    at = np.flatnonzero(grams >= 0)
    owner, place = letters.owner[at], letters.place[at]
    # the global order: by frequency, then by name
    rank = frequency[grams[at]] * 65536 + grams[at]
    order = np.lexsort((place, rank, owner))
    firsts = np.searchsorted(owner, np.arange(len(words)))
    third = rank[order][firsts + 2]
    held = np.flatnonzero(rank <= third[owner])
    owner, place, cost = owner[held], place[held], frequency[grams[at[held]]]
    pivot = np.zeros(len(held), dtype=bool)
    bounds = np.searchsorted(owner, np.arange(len(words) + 1))
    places, costs = place.tolist(), cost.tolist()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        one, two = choose_pivots(places[a:b], costs[a:b])
        for k in range(a, b):
            pivot[k] = places[k] == one or places[k] == two
    return owner, place, pivot


def _keys(letters: Letters, word: np.ndarray, place: np.ndarray, side: int) -> np.ndarray:
    """Bigram and the letters on its equal side, as one 64-bit number."""
    first = letters.starts[word] + place
    gram = letters.codes[first] * _U(0x110000) + letters.codes[first + 1]
    rest = letters.before(word, place) if side == LEFT else letters.after(word, place + 2)
    return _mix(_mix(gram * _U(2) + _U(side)) + rest).astype(np.int64)


class Bucket:
    """Rows with equal keys: words with the place and side of the bigram they share."""

    def __init__(self, key: np.ndarray, words: list[str], mark: np.ndarray):
        self.key, self.words = key.astype(np.uint64), words
        self.pivot = (mark & 1).astype(bool)
        side, place = (mark >> 1) & 1, mark >> 2
        self.letters = Letters(words)
        # the edited side of each word
        self.low = np.where(side == LEFT, place + 2, 0)
        self.high = np.where(side == LEFT, self.letters.sizes, place)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, hash, kind): each row's word with one letter of the edited side masked (kind
        0) or left out (1), and whole (2). Two different words share a hash of kind 0, or the
        one's of kind 1 is the other's of kind 2, if they differ by one letter there."""
        size = self.high - self.low
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + self.low[row]
        two = self.letters.before(row, at) + _U(3) * self.letters.after(row, at + 1)
        whole = np.arange(len(size))
        names = [_mix(self.key[row] + _mix(two)), _mix(self._joined(row, at, at + 1)), _mix(self._joined(whole, self.low, self.low))]
        kinds = np.repeat([0, 1, 2], [len(row), len(row), len(whole)])
        return np.concatenate([row, row, whole]), np.concatenate(names), kinds

    def _joined(self, row: np.ndarray, cut_from: np.ndarray, cut_to: np.ndarray) -> np.ndarray:
        """Hash of the edited side without the letters between; additive in its letters."""
        codes, starts = self.letters, self.letters.starts[row]
        size = (self.high - self.low)[row] - (cut_to - cut_from)
        ahead = codes._ahead
        head = ahead[starts + cut_from] - ahead[starts + self.low[row]]
        tail = ahead[starts + self.high[row]] - ahead[starts + cut_to]
        # tails of shortened words lie one place further: bring them to the same power
        moved = np.where(cut_to > cut_from, tail * _INVERSE, tail)
        return (head + moved) ^ _mix(self.key[row] + size.astype(np.uint64) * _U(0x51ED27))


#: The inverse of the hash's odd multiplier modulo 2^64.
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def one_edit(a: str, b: str) -> bool:
    """Whether the two differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if a == b or len(a) - len(b) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[same + 1 :] == (b[same + 1 :] if len(a) == len(b) else b[same:])


def _pairs(row: np.ndarray, name: np.ndarray, kind: np.ndarray, pivot: np.ndarray, words: list[str]) -> list[tuple[int, int]]:
    """Row pairs that share a name in a way that may mean one edit, one of them by a pivot."""
    kept = np.where(kind == 0, 0, 1)
    order = np.lexsort((row, name, kept))
    row, name, kept, kind = row[order], name[order], kept[order], kind[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (kept[1:] != kept[:-1])
    bounds = np.append(np.flatnonzero(new), len(row))
    sizes = np.diff(bounds)
    found: set[tuple[int, int]] = set()
    whole = np.add.reduceat(kind == 2, bounds[:-1]) if len(row) else sizes
    worth = (sizes > 1) & ((kept[bounds[:-1]] == 0) | (whole > 0))
    rows, kinds, flags = row.tolist(), kind.tolist(), pivot.tolist()
    for a, size in zip(bounds[:-1][worth].tolist(), sizes[worth].tolist()):
        for i in range(a, a + size - 1):
            x, kx = rows[i], kinds[i]
            for j in range(i + 1, a + size):
                y = rows[j]
                if x != y and (kx == 0 or kx + kinds[j] == 3) and (flags[x] or flags[y]) and (x, y) not in found:
                    if one_edit(words[x], words[y]):
                        found.add((x, y))
    return list(found)


_NEAR = "word string, near string, near_n long, hash long, kind int, pivot boolean"


def _near_batch(words: list, near: list, near_n: list, hashes: list | None = None, kinds: list | None = None, pivot: list | None = None) -> pa.RecordBatch:
    none = [None] * len(words)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(words, pa.string()), pa.array(near, pa.string()), pa.array(near_n, pa.int64()),
            pa.array(none if hashes is None else hashes, pa.int64()),
            pa.array(none if kinds is None else kinds, pa.int32()),
            pa.array(none if pivot is None else pivot, pa.bool_()),
        ],
        names=["word", "near", "near_n", "hash", "kind", "pivot"],
    )


def _verified(words: list[str], counts: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = [x for x, _ in found], [y for _, y in found]
    whole = lambda rows: [words[r] for r in rows]
    return _near_batch(whole(a + b), whole(b + a), [int(counts[r]) for r in b + a])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each key. Rows come sorted by key. A key with more than MOST rows gives
    its variants instead, which are grouped once more."""

    def ready(key: np.ndarray, words: list[str], mark: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        size, pivots = np.bincount(group), np.bincount(group, weights=mark & 1)
        keep = np.flatnonzero((size > 1)[group] & (pivots > 0)[group])
        if len(keep):
            bucket = Bucket(key[keep], [words[i] for i in keep.tolist()], mark[keep])
            found = _pairs(*bucket.variants(), bucket.pivot, bucket.words)
            yield _verified(bucket.words, n[keep], found)

    def dealt(key: np.ndarray, words: list[str], mark: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(key), STEP):
            part = slice(a, a + STEP)
            bucket = Bucket(key[part], words[part], mark[part])
            row, name, kind = bucket.variants()
            own = [bucket.words[r] for r in row.tolist()]
            yield _near_batch(own, [None] * len(own), n[part][row].tolist(), name.astype(np.int64).tolist(), kind.tolist(), bucket.pivot[row].tolist())

    hot, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, mark, n = (batch.column(c).to_numpy() for c in ("key", "mark", "n"))
        words = batch.column("word").to_pylist()
        if hot is not None:
            end = int(np.searchsorted(key, hot, side="right")) if key[0] == hot else 0
            yield from dealt(key[:end], words[:end], mark[:end], n[:end])
            if end == len(key):
                continue
            hot, key, words, mark, n = None, key[end:], words[end:], mark[end:], n[end:]
        if held is not None:
            key, mark, n = (np.concatenate([x, y]) for x, y in zip((held[0], held[2], held[3]), (key, mark, n)))
            words = held[1] + words
        held = (key, words, mark, n)
        if len(key) < STEP:
            continue
        last = int(np.searchsorted(key, key[-1]))
        yield from ready(key[:last], words[:last], mark[:last], n[:last])
        held = (key[last:], words[last:], mark[last:], n[last:])
        if len(held[0]) > MOST:
            yield from dealt(*held)
            hot, held = int(held[0][0]), None
    if held is not None:
        yield from ready(*held)


def _compared_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words among the variants of large keys; rows come sorted by hash."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("hash", "kind", "pivot", "near_n")]
        words = batch.column("word").to_pylist()
        if held is not None:
            columns = [np.concatenate([x, y]) for x, y in zip(held[0], columns)]
            words = held[1] + words
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last:
            found = _pairs(np.arange(last), columns[0][:last], columns[1][:last], columns[2][:last], words[:last])
            yield _verified(words[:last], columns[3][:last], found)
        held = ([c[last:] for c in columns], words[last:])
    if held is not None:
        found = _pairs(np.arange(len(held[1])), *held[0][:3], held[1])
        yield _verified(held[1], held[0][3], found)


def bigram_frequencies(words: DataFrame) -> np.ndarray:
    """How often each of the 65536 bigram names occurs in the words: a table of fixed size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, dtype=np.int64)
        for batch in batches:
            grams = Letters(batch.column("word").to_pylist()).grams()
            total += np.bincount(grams[grams >= 0], minlength=65536)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = words.select("word").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(65536, dtype=np.int64)
    for r in rows:
        out[r.gram] = r.n
    return out


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words of (word, n) one edit apart, in both directions.
    Words are distinct and have four code points at least."""
    spark = words.sparkSession
    frequency = spark.sparkContext.broadcast(bigram_frequencies(words))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            owner, place, pivot = signature_rows(held, frequency.value)
            letters = Letters(held)
            for side in (LEFT, RIGHT):
                mark = place * 4 + side * 2 + pivot
                own = [held[i] for i in owner.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_keys(letters, owner, place, side)), pa.array(own, pa.string()), pa.array(mark), pa.array(n[owner])],
                    names=["key", "word", "mark", "n"],
                )

    rows = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(signed, "key long, word string, mark long, n long")
    found = cut(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compared, _NEAR))
    pairs = found.where("hash is null")
    large = found.where("hash is not null")
    again = large.repartition("hash").sortWithinPartitions("hash").mapInArrow(_compared_again, _NEAR)
    both = pairs.unionByName(again).select("word", "near", "near_n")
    # one shuffle serves the distinct pairs and, later, the grouping by word
    return both.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def group_spellings(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Each word of (word, n) with its form, the near word of largest n (ties: the smallest)
    if that is at least ``ratio`` times its own n, and the root, the last form reached.

    Columns: word, form, root, n, n_near, form_n. Words are distinct; equal rows count as one,
    and of a word with several n the largest counts. Rows without word or n are left out, words
    of fewer than four code points have no near words; an empty table gives an empty table.
    Further columns are ignored.
    """
    given = words.where("word is not null and n is not null").groupBy("word").agg(F.max(F.col("n").cast("long")).alias("n"))
    given = cut(given)
    near = near_words(given.where(F.length("word") >= 4)).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    near_n = -F.col("best.less")
    stands = near_n >= ratio * F.col("n")
    formed = cut(
        given.join(near, "word", "left").select(
            "word",
            F.when(stands, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(stands, near_n).alias("form_n"),
        )
    )
    # n grows by the ratio at each form, so this many rounds reach every root
    span = formed.agg(F.max("n").alias("most"), F.min("n").alias("least")).first()
    hops, most = 0, span.most or 0
    while span.least and most >= max(1, span.least) * ratio:
        hops, most = hops + 1, most // ratio
    up = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(hops.bit_length()):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        up = cut(up.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return formed.join(up, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): maximal runs of letters up to U+00FF in all whole texts, A-Z lower-cased, with
    at least so many code points and occurrences. A run whose crc32 with the document's id is
    divisible by ``every`` loses the code point that the crc32 names. Null texts have no words;
    a null id counts as the empty text."""
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % least_length)
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            held = [w.decode("latin-1") for w in total]
            return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                seed = zlib.crc32(f"{doc_id}:".encode())
                # other code points become question marks, one each
                held = Counter(runs.findall(text.as_py().encode("latin-1", "replace").translate(lower)))
                for run, n in held.items():
                    crc = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
                    if crc % every == 0:
                        at = crc % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
                if len(total) > COUNTED:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    counts = rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


@query("op12_spelling")
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among all words of all documents."""
    return group_spellings(corpus_words(table(spark, sf_dir, "documents")))
