"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents that hold
benchmark passages go, sources are mixed to their target weights, and the rest is dealt into shards.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and works on all of them; ``run``
writes each stage's result as Parquet in the folder the cluster shares and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mixing, neardup, sharding, toxicity
from ledgerloom.llm.common import durable, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score under its threshold.  Labels of the held-out fold are not learnt."""
    toxic = toxicity.scorer(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxic(F.col("text")) < toxicity.REJECT)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return neardup.kept_documents(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, from no to three times."""
    return mixing.mixed_documents(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, 0 to 15, and their slot in it."""
    return sharding.interleave(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: Trained models and iterations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
