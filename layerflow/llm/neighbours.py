"""Approximate nearest neighbours by a forest of random-projection trees.

A tree cuts space by hyperplanes that halve its sample; a query goes through all trees at once
with one priority queue of tree nodes, ordered by how far the query lies on the far side of the
nearest cut passed, and takes leaves until its share of all leaves is reached. The rows of these
leaves are its candidates, which are ranked by their exact cosine.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layerflow.llm.common import query, table
from layerflow.session import cut

#: Rows the trees are cut by: at most so many, the first in an order by hash.
SAMPLE_ROWS = 20_000
TREES = 48
#: A node of at most so many sample rows is a leaf.
LEAF_ROWS = 16
#: A query visits so many leaves, of all trees together, as this share of one tree's leaves, and
#: LEAST_LEAVES at least. Recall at 5 is above 0.9 even on vectors without clusters.
SHARE, LEAST_LEAVES = 0.35, 64
NEAREST = 5
#: Queries whose vectors and leaves are sent to all tasks at once.
BLOCK_QUERIES = 1024

#: Scores from matrix products may differ from the exact ones by less than this.
SLACK = 1e-9


class Tree:
    """Hyperplanes of one tree. Children are node numbers, or -1 - leaf."""

    def __init__(self, planes: np.ndarray, cuts: np.ndarray, low: np.ndarray, high: np.ndarray, leaves: int):
        self.planes, self.cuts, self.low, self.high, self.leaves = planes, cuts, low, high, leaves

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, planes=self.planes, cuts=self.cuts, low=self.low, high=self.high, leaves=self.leaves)
        return held.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Tree:
        held = np.load(io.BytesIO(data))
        return Tree(held["planes"], held["cuts"], held["low"], held["high"], int(held["leaves"]))

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        if not len(self.cuts):
            return np.zeros(len(rows), dtype=np.int64)
        at, going = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(going):
            node = at[going]
            side = np.einsum("ij,ij->i", rows[going], self.planes[node]) > self.cuts[node]
            at[going] = np.where(side, self.high[node], self.low[node])
            going = going[at[going] >= 0]
        return -1 - at


def _direction(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The difference of two random rows, each moved towards the middle of the rows near it."""
    some = rows[rng.choice(len(rows), min(len(rows), 100), replace=False)]
    a, b = some[0], some[-1]
    for _ in range(4):
        near = some @ (a - b) > (a @ a - b @ b) / 2
        if near.all() or not near.any():
            break
        a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
    return a - b


def grow(sample: np.ndarray, seed: int, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over sample rows. A node whose rows a cut does not part stays a leaf, so equal
    rows never make it endless."""
    rng = np.random.default_rng(seed)
    planes, cuts, low, high, leaves = [], [], [], [], 0
    todo = [(np.arange(len(sample)), -1, False)]
    while todo:
        rows, parent, is_high = todo.pop()
        side = None
        if len(rows) > leaf_rows:
            plane = _direction(sample[rows], rng)
            heights = sample[rows] @ plane
            middle = float(np.median(heights))
            side = heights > middle
        if side is None or side.all() or not side.any():
            me = -1 - leaves
            leaves += 1
        else:
            me = len(cuts)
            planes.append(plane)
            cuts.append(middle)
            low.append(0)
            high.append(0)
            todo += [(rows[~side], me, False), (rows[side], me, True)]
        if parent >= 0:
            (high if is_high else low)[parent] = me
    shape = (len(cuts), sample.shape[1] if sample.ndim == 2 else 0)
    whole = [np.array(x, dtype=np.int64) for x in (low, high)]
    return Tree(np.array(planes, dtype=np.float64).reshape(shape), np.array(cuts), *whole, leaves)


class Forest:
    """Trees with one numbering of all their leaves."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.offsets = np.cumsum([0, *[t.leaves for t in trees]])

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: rows x trees."""
        found = [tree.leaf_of(rows) + first for tree, first in zip(self.trees, self.offsets)]
        return np.stack(found, axis=1).astype(np.int32)

    def search(self, rows: np.ndarray, share: float = SHARE) -> Iterator[list[int]]:
        """For each query the leaves it visits. One queue holds nodes of all trees; the next is
        the one with the largest smallest margin on the way to it."""
        wanted = max(LEAST_LEAVES, int(np.ceil(share * self.offsets[-1] / len(self.trees))))
        margins = [rows @ t.planes.T - t.cuts if len(t.cuts) else np.zeros((len(rows), 0)) for t in self.trees]
        sides = [(t.low.tolist(), t.high.tolist()) for t in self.trees]
        first = self.offsets.tolist()
        for i in range(len(rows)):
            mine = [m[i].tolist() for m in margins]
            queue = [(-np.inf, k, 0 if len(mine[k]) else -1) for k in range(len(self.trees))]
            found: list[int] = []
            while queue and len(found) < wanted:
                worst, k, node = heapq.heappop(queue)
                low, high = sides[k]
                margin = mine[k]
                # down the near side to its leaf; far sides wait in the queue
                while node >= 0:
                    m = margin[node]
                    near, far = (high[node], low[node]) if m > 0 else (low[node], high[node])
                    behind = -m if m < 0 else m
                    heapq.heappush(queue, (behind if behind > worst else worst, k, far))
                    node = near
                found.append(first[k] - 1 - node)
            yield found


def _usable(vector: str, dims: int) -> Column:
    """Vectors of ``dims`` finite components, not all zero."""
    return (
        (F.size(vector) == dims)
        & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.exists(vector, lambda x: x != 0)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay in range
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def fit_forest(rows: DataFrame, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS) -> Forest:
    """Trees grown in parallel tasks over the same bounded sample of (vec_id, vector)."""
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").toArrow()["vector"]
    sample = _matrix(drawn.combine_chunks())
    sample = spark.sparkContext.broadcast(_unit(sample) if len(sample) else sample)

    def grown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [grow(sample.value, int(seed), leaf_rows).to_bytes() for seed in batch["id"]]
            yield pd.DataFrame({"id": batch["id"], "tree": made})

    seeds = spark.range(0, trees, 1, min(trees, 64))
    found = seeds.mapInPandas(grown, "id long, tree binary").collect()
    return Forest([Tree.from_bytes(r.tree) for r in sorted(found, key=lambda r: r.id)])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores of different ids, ties to the smaller id."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    k: int = NEAREST,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    block: int = BLOCK_QUERIES,
    sample_rows: int = SAMPLE_ROWS,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of each row for which ``queries`` holds: (query_id, rank, vec_id,
    score), with the exact cosine as score, nearest first, ties to the smaller id.

    The forest is fitted on at most ``sample_rows`` rows; all rows are indexed. Queries are
    taken in blocks of ``block`` (1024 queries are 13 MB at 2048 leaves a tree): each
    block's vectors and leaves go to all tasks, every task marks which of its rows lie in a
    leaf that a query visits, scores these, and keeps k for each query. Vectors are neither
    shuffled nor grouped by leaf, so a leaf with a third of all rows is read where it lies.

    No part take rows with a null id or vector, a null or non-finite component, only zeros, or
    another length than most rows have. Rows that repeat an id count as one id: a query's own
    id is never found, others once, at their best score. With fewer than k candidates fewer
    rows come; an empty table gives none. Further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where("vec_id is not null and vector is not null")
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = lengths.dims if lengths else 0
    rows = rows.where(_usable("vector", dims))
    forest = spark.sparkContext.broadcast(fit_forest(rows, trees, sample_rows, leaf_rows))
    # Floats stay floats in the index; their doubles are the same numbers.
    kept = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = _matrix(batch.column("vector"))
            leaves = forest.value.leaves_of(_unit(whole)) if len(whole) else np.zeros((0, trees), dtype=np.int32)
            raw = whole.astype(np.float32 if kept == "float" else np.float64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("asks"),
                    pa.array([r.tobytes() for r in raw], pa.binary()),
                    pa.array([r.tobytes() for r in leaves], pa.binary()),
                ],
                names=["vec_id", "asks", "vector", "leaves"],
            )

    index = cut(rows.mapInArrow(indexed, "vec_id long, asks boolean, vector binary, leaves binary"))
    number = np.float32 if kept == "float" else np.float64

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = np.frombuffer(b"".join(batch["vector"]), dtype=number).astype(np.float64).reshape(-1, dims)
            found = forest.value.search(_unit(whole), share) if len(whole) else []
            yield batch.assign(visits=[np.array(v, dtype=np.int32).tobytes() for v in found])

    asking = index.where("asks").select("vec_id", "vector").distinct()
    order = Window.partitionBy("part").orderBy("vec_id", "vector")
    # Numbered within hash parts; a block is a range of parts' own blocks, so none is larger.
    parted = asking.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    dealt = parted.withColumn("block", F.floor((F.row_number().over(order) - 1) / max(1, block // 64)))
    # the search costs far more than its few bytes tell
    spread = dealt.select("vec_id", "vector", "block").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    visits = cut(spread.mapInPandas(searched, "vec_id long, vector binary, block long, visits binary"))
    blocks = (visits.agg(F.max("block")).first()[0] or 0) + 1 if dims else 0
    found = None
    for number_of_block in range(blocks):
        part = visits.where(F.col("block") == number_of_block).select("vec_id", "vector", "visits").toPandas()
        hits = cut(_scored(index, part, forest, dims, k, number))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scored(index: DataFrame, part: pd.DataFrame, forest, dims: int, k: int, number) -> DataFrame:
    """(query_id, vec_id, score): the k best candidates of each query in each task."""
    total = int(forest.value.offsets[-1])
    width = -(-max(1, len(part)) // 8)
    asked = np.zeros((total, width * 8), dtype=bool)
    for i, held in enumerate(part["visits"]):
        asked[np.frombuffer(held, dtype=np.int32), i] = True
    ids = part["vec_id"].to_numpy(dtype=np.int64)
    whole = np.frombuffer(b"".join(part["vector"]), dtype=number).astype(np.float64).reshape(-1, dims)
    # leaves x queries, a bit each
    sent = index.sparkSession.sparkContext.broadcast((ids, _unit(whole) if len(whole) else whole, np.packbits(asked, axis=1)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asks, vectors, bits = sent.value
        held: list[list] = [[] for _ in asks]
        least = np.full(len(asks), -np.inf)
        for batch in batches:
            for start in range(0, len(batch), 4096):
                rows = batch.iloc[start : start + 4096]
                vec_ids = rows["vec_id"].to_numpy(dtype=np.int64)
                leaves = np.frombuffer(b"".join(rows["leaves"]), dtype=np.int32).reshape(len(rows), -1)
                units = _unit(np.frombuffer(b"".join(rows["vector"]), dtype=number).astype(np.float64).reshape(-1, dims))
                marks = bits[leaves[:, 0]]
                for t in range(1, leaves.shape[1]):
                    marks |= bits[leaves[:, t]]
                marked = np.unpackbits(marks, axis=1, count=len(asks)).T.astype(bool)
                for i in range(len(asks)):
                    own = np.flatnonzero(marked[i])
                    rough = units[own] @ vectors[i]
                    good = own[(rough >= least[i] - SLACK) & (vec_ids[own] != asks[i])]
                    if not len(good):
                        continue
                    if len(good) > 4 * k:
                        rough = units[good] @ vectors[i]
                        # ids may repeat, so the bound counts different ids
                        top = _top(rough, vec_ids[good], k)
                        good = good[rough >= rough[top[-1]] - SLACK] if len(top) == k else good
                    exact = (units[good] * vectors[i]).sum(axis=1)
                    pool = held[i] + list(zip(exact.tolist(), vec_ids[good].tolist()))
                    scores, names = np.array([p[0] for p in pool]), np.array([p[1] for p in pool], dtype=np.int64)
                    top = _top(scores, names, k)
                    held[i] = [pool[j] for j in top]
                    if len(top) == k:
                        least[i] = held[i][-1][0]
        out = [(int(asks[i]), name, score) for i, pool in enumerate(held) for score, name in pool]
        yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return index.select("vec_id", "vector", "leaves").mapInPandas(score, "query_id long, vec_id long, score double")


@query("op13_neighbours")
def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
