"""Quality scores by compression with dictionaries of good and bad text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import query, table, text_or_empty

#: Labelled documents that are read for each class and purpose (dictionary, calibration). The
#: model is fitted on at most four times as many documents, whatever the size of the corpus.
SAMPLE_DOCS = 2000
#: Evenly spaced pieces that one sampled document gives to its dictionary.
SAMPLE_PIECES = 32
#: Bytes that are compressed at a time. A longer piece is compressed by its own repetitions
#: more than by the dictionary.
PIECE = 512
DICTIONARY = 112_640
LEVEL = 1
THRESHOLD = 0.3


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from learning: by the CRC-32 of its id as text. Null counts as
    the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


@dataclass
class Model:
    """Two dictionaries (bad, good), and a logistic curve over the difference of sizes. Without
    labels of both kinds there are no dictionaries, and every text gets the share of ones."""

    dictionaries: tuple[bytes, bytes] | None
    slope: float
    start: float

    def differences(self, texts: Iterator[pd.Series]) -> Iterator[np.ndarray]:
        """The normalised compressed-size difference: (bad - good) / (bad + good)."""
        both = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(d),
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
            )
            for d in self.dictionaries or ()
        ]
        for batch in texts:
            out = np.zeros(len(batch))
            for i, text in enumerate(batch) if both else ():
                cut = pieces(text)
                bad, good = (sum([len(c.compress(p)) for p in cut]) for c in both)
                out[i] = (bad - good) / (bad + good) if cut else 0.0
            yield out

    def curve(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.start, -30.0, 30.0)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and start of the logistic curve of y over x, by Newton's method with a slight
    penalty on the slope. A row counts ``weight`` times."""
    spread = x.std() or 1.0
    a = np.column_stack([x / spread, np.ones(len(x))])
    w, penalty = np.zeros(2), np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ w, -30.0, 30.0)))
        grad = a.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1])


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text for a trained one: its end serves as it is
        return b"".join(samples)[-DICTIONARY:]


def fit_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents: ``labels`` has (doc_id, quality), quality 1 being good.

    For each class, ``sample_docs`` documents with the lowest hashes of their ids give the
    dictionary (at most SAMPLE_PIECES evenly spaced pieces of each), and as many others, whole,
    calibrate; these are weighed by the numbers of labels, so that the mix of the classes is
    that of all labels whatever the bound. Rows with a null id or another label are left
    out; an id that is labelled twice counts by its higher label. Only the sampled ids are
    broadcast, and only pieces and scores of those documents reach the driver.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y"))
    known = known.withColumn("__h", F.xxhash64("doc_id")).withColumn("role", F.pmod("__h", F.lit(2)))
    some = [
        known.where((F.col("y") == y) & (F.col("role") == role)).orderBy("__h", "doc_id").limit(sample_docs)
        for y in (0, 1)
        for role in (0, 1)
    ]
    ids = some[0]
    for other in some[1:]:
        ids = ids.unionByName(other)
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.y, r.role) for r in ids.collect()], "doc_id long, y int, role int")
    sampled = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, y, text in zip(batch["doc_id"], batch["y"], batch["text"]):
                cut = pieces(text)
                chosen = [cut[len(cut) * k // SAMPLE_PIECES] for k in range(SAMPLE_PIECES)] if len(cut) > SAMPLE_PIECES else cut
                yield pd.DataFrame({"y": y, "doc_id": doc, "place": range(len(chosen)), "piece": chosen})

    found = sampled.where("role = 0").select("doc_id", "y", "text").mapInPandas(
        spread, "y int, doc_id long, place int, piece binary"
    )
    by_class: tuple[list, list] = ([], [])
    for r in sorted(found.collect(), key=lambda r: (hash((r.doc_id * 2654435761 + r.place) % 4294967291), r.doc_id, r.place)):
        by_class[r.y].append(bytes(r.piece))
    if not all(by_class):
        ones = sum(r.y for r in ids.collect()) if ids.count() else 0
        share = (ones + 1) / (ids.count() + 2)
        return Model(None, 0.0, float(np.log(share / (1 - share))))
    model = Model((_dictionary(by_class[0]), _dictionary(by_class[1])), 1.0, 0.0)

    def differ(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(pd.Series, model.differences(texts))

    difference = F.pandas_udf(differ, "double")
    rows = sampled.where("role = 1").select("y", "text").select("y", difference("text").alias("x")).collect()
    x, y = np.array([r.x for r in rows]), np.array([float(r.y) for r in rows])
    if len(set(y)) < 2:
        return model
    # as many of each class as are labelled, not as are sampled: the curve does not depend on
    # where the bound of the sample lies
    counts = {r.y: r.n for r in known.where("role = 1").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = np.array([counts[int(v)] / (y == v).sum() for v in y])
    slope, start = _logistic(x, y, weight / weight.mean())
    return Model(model.dictionaries, slope, start)


def score_quality(docs: DataFrame, model: Model, keep: list[str], into: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of every whole text, from 0 to 1.

    Null and empty texts have no difference in size and get the value of the curve at 0.
    Nothing is shuffled; a task holds one batch of texts at a time.
    """

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for difference in model.differences(texts):
            yield pd.Series(model.curve(difference))

    run = F.pandas_udf(score, "double")
    return docs.select(*[F.col(k) for k in keep], run(text_or_empty()).alias(into))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learnt from the labels outside the held-out part."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)))
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
