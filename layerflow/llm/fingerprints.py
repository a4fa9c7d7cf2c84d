"""Document fingerprints by locally consistent parsing (Sahinalp and Vishkin 1996)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from layerflow.llm.common import query, table, text_or_empty

#: Values of a fingerprint, and hexadecimal digits of each.
VALUES, DIGITS = 64, 4
#: Phrases count from this level of the parse on; they have about ten characters and more.
LOWEST = 2
#: Rounds of coin tossing: 64-bit names become labels below 128, then 14, then 8.
TOSSES = 3
#: Code points that are parsed at a time.
BATCH = 1 << 15
#: Rows that are looked at to cut the documents into ranges, for each range.
SPLIT_ROWS = 50

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of deterministic coin tossing: the lowest bit in which a name differs from the
    one before it, and the value of that bit, as 2 * place + value. Neighbours that differed
    still differ. The first name of a text has nothing before it; its lowest bit counts."""
    low = names.copy()
    low[1:] ^= names[:-1]
    low[first] = 1
    low &= -low
    at = np.bitwise_count(low - low.dtype.type(1))
    return (at << 1) | ((names & low) != 0)


#: Odd factors: multiplying by each orders the names anew.
ORDERS = _mix(np.arange(1, VALUES + 1, dtype=np.uint64) * _A) | np.uint64(1)


def _labels() -> np.ndarray:
    """The further rounds on labels below 128, as a table over (label before, label)."""
    own = np.tile(np.arange(128, dtype=np.uint8), 128)
    before = np.repeat(np.arange(128, dtype=np.uint8), 128)
    low = (before ^ own).astype(np.int16)
    low &= -low
    return ((np.bitwise_count(np.maximum(low, 1) - 1) << 1) | ((own & low) != 0)).astype(np.uint8)


_NEXT = _labels()


def _blocks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases begin: at local maxima of the tossed labels, and at each text's start."""
    labels = _toss(names, first)
    for _ in range(TOSSES - 1):
        before = np.empty(len(labels), dtype=np.uint16)
        before[1:] = labels[:-1]
        before[0] = 0
        before[first] = labels[first] ^ 1
        labels = _NEXT[(before << 7) | labels]
    high = first.copy()
    last = np.append(first[1:], True)  # what follows it belongs to another text
    high[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~last[1:-1]
    return high


def phrases(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The phrases of several texts, level by level, as (text, name).

    Each level first makes one name of every run of equal names, so that neighbours differ,
    then cuts phrases where coin tossing finds a local maximum, and names each phrase by its
    content. A cut depends on a few names around it only: equal substrings are cut alike
    wherever they stand, except near their ends. The last name of a text stands for all of it.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    level = 0
    while len(names):
        first = np.ones(len(doc), dtype=bool)
        first[1:] = doc[1:] != doc[:-1]
        starts = np.flatnonzero(first | np.concatenate([[True], names[1:] != names[:-1]]))
        if len(starts) < len(names):
            run = np.diff(np.append(starts, len(names))).astype(np.uint64)
            names, doc, first = names[starts], doc[starts], first[starts]
            names = names.astype(np.uint64)
            names[run > 1] = _mix(names[run > 1] + run[run > 1] * _A)
        starts = np.flatnonzero(_blocks(names, first))
        size = np.diff(np.append(starts, len(names)))
        inside = (np.arange(len(names)) - np.repeat(starts, size)).astype(np.uint64)
        inside *= _A
        inside ^= names
        names = _mix(np.add.reduceat(_mix(inside), starts) + np.uint64(level + 1))
        doc, first = doc[starts], first[starts]
        level += 1
        alone = first & np.append(first[1:], True)  # the whole text is one phrase now
        if level >= LOWEST:
            yield doc, names
        else:
            yield doc[alone], names[alone]
        names, doc = names[~alone], doc[~alone]


def _sketch(texts: list[str]) -> list[str]:
    found = [*phrases(texts)]
    lowest = np.full((len(texts), VALUES), np.uint64(0xFFFFFFFFFFFFFFFF))
    if found:
        doc, names = np.concatenate([d for d, _ in found]), np.concatenate([n for _, n in found])
        order = np.argsort(doc, kind="stable")
        doc, names = doc[order], names[order]
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        for k in range(VALUES):
            lowest[doc[starts], k] = np.minimum.reduceat(names * ORDERS[k], starts)
    low = (_mix(lowest) >> np.uint64(64 - 4 * DIGITS)).astype(">u2").tobytes().hex()
    width = VALUES * DIGITS
    return [low[i * width : (i + 1) * width] if t else "" for i, t in enumerate(texts)]


def fingerprint_texts(texts: list[str]) -> list[str]:
    """The fingerprints of texts: for each of 64 hash orders, 16 bits of the lowest of the
    text's phrases. The empty text has the empty fingerprint."""
    out, some, size = [], [], 0
    for text in texts:
        if some and size + len(text) > BATCH:
            out += _sketch(some)
            some, size = [], 0
        some.append(text)
        size += len(text)
    return out + (_sketch(some) if some else [])


def likeness_of(a: str, b: str) -> float:
    """The part of equal values of two fingerprints, which estimates the part of phrases that
    two texts share. Two empty ones are alike, an empty and another one are not."""
    if not a or not b:
        return float(a == b)
    return sum([a[i : i + DIGITS] == b[i : i + DIGITS] for i in range(0, len(a), DIGITS)]) / VALUES


@F.pandas_udf(StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series(fingerprint_texts(list(texts)), dtype=object)


@F.pandas_udf(DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness_of(x, y) for x, y in zip(a, b)], dtype=float)


def fingerprint_documents(docs: DataFrame, into: str = "fingerprint") -> DataFrame:
    """All rows with the fingerprint of their whole text; null counts as empty. Nothing is
    shuffled. A column named like the new one is replaced."""
    return docs.withColumn(into, fingerprint(text_or_empty()))


def with_next(docs: DataFrame, order: str, hashed: str, ranges: int, carry: list[str]) -> DataFrame:
    """Each row beside the row that follows it by (order, hashed), as ``next_`` columns; the
    first follows the last. A null order comes last. Rows that are equal in both columns must
    be equal in all.

    Rows are dealt to ranges of the order, cut at rows of a bounded sample. The row at which a
    range begins is sent to the range before it as well, so that every range knows what follows
    its last row. No task has more than one range, and texts are shuffled once.
    """
    key = [F.col(order).isNull().alias("late"), F.coalesce(F.col(order), F.lit(0)).alias("o"), F.col(hashed).alias("h")]
    keys = docs.select(*key)
    total = keys.agg(F.count(F.lit(1)), F.min(F.struct("late", "o", "h"))).first()
    if not total[0]:
        cuts = []
    else:
        share = min(1.0, ranges * SPLIT_ROWS / total[0])
        near = F.pmod(F.xxhash64("o", "h"), F.lit(1 << 40)) < int(share * (1 << 40)) + 1
        some = sorted({(r.late, r.o, r.h) for r in keys.where(near).collect()})
        cuts = sorted({tuple(total[1]), *(some[len(some) * i // ranges] for i in range(ranges) if some)})
    at = {cut: i for i, cut in enumerate(cuts)}

    @F.pandas_udf("array<int>")
    def dealt(late: pd.Series, o: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for row in zip(late.tolist(), o.tolist(), h.tolist()):
            own = bisect_right(cuts, row) - 1
            out.append([own, -1 - (at[row] - 1) % len(cuts)] if row in at else [own])
        return pd.Series(out)

    # A place below zero is a copy of the next range's first row.
    placed = docs.select("*", F.explode(dealt(*key)).alias("__place"))
    placed = placed.withColumn("__copy", F.col("__place") < 0).withColumn(
        "__range", F.when(F.col("__copy"), -1 - F.col("__place")).otherwise(F.col("__place"))
    )
    inside = Window.partitionBy("__range").orderBy("__copy", F.col(order).isNull(), order, hashed)
    followed = placed.select("*", *[F.lead(c).over(inside).alias(f"next_{c}") for c in carry])
    return followed.where(~F.col("__copy")).drop("__place", "__copy", "__range")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents and of their edited texts, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    docs = fingerprint_documents(docs.withColumn("hashed", F.xxhash64("text")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(docs, "doc_id", "hashed", ranges, ["text", "fingerprint"])
    n = F.length("text")
    changed = F.least(F.floor(n / 4), F.length("next_text")).cast("int")
    rows = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        "fingerprint",
        "next_fingerprint",
        F.concat(F.substr("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substr("next_text", F.lit(1), changed)).alias("edited"),
    )
    rows = rows.select("*", fingerprint("edited").alias("edited_fingerprint"), F.sha2("edited", 256).alias("edited_sha256"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
