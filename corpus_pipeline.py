"""The corpus pipeline: documents in, the sharded mix out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.decontamination import drop_leaked
from layerflow.llm.jaccard import drop_near_copies
from layerflow.llm.language import UNKNOWN, label_documents, learnt
from layerflow.llm.mixing import mix_sources
from layerflow.llm.sharding import shard_documents
from layerflow.session import cut
from layerflow.sources import read_dataset

#: A document goes if less than half of its letters are evidence for the languages of its spans.
LEAST_EVIDENCE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in learnt languages, one or several: those without letters go, and those
    whose letters are mostly of other scripts or in sequences that were never seen. Null texts
    go as well."""
    found = label_documents(docs, learnt(docs), spans=False)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("evidence") >= LEAST_EVIDENCE)).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents without benchmark items."""
    return drop_leaked(docs, read_dataset(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source's documents as often as the target weights ask for."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the mix into shards by document id."""
    return shard_documents(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage decodes spans with a learnt model, which SQL cannot express; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again as the next one's."""
    docs = read_dataset(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
