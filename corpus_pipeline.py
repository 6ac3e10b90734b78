"""From raw documents to training shards, in stages that each work on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek.llm import decontaminate, mixing, near_dedup, quality, sharding
from lumenseek.llm.common import table
from lumenseek.session import shared_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"
    return quality.scored(docs, trees, score).where(f"{score} >= {quality.THRESHOLD}").drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id."""
    return near_dedup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = f"found_{uuid.uuid4().hex}"
    marked = decontaminate.matched(docs, table(spark, sf_dir, "benchmark"), found)
    return marked.where(F.size(f"{found}.hit") == 0).drop(found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of the languages; none is dropped, as rates are at least one.

    Null texts have the prior as posterior and are repeated like any other; an empty table stays empty.
    """
    return mixing.repeated(docs, docs.select("doc_id", "text", F.col("lang").alias("domain")), least=1.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, text included, with its shard and its slot there; equal rows get a slot each."""
    return sharding.sharded(docs)


STAGES = [("quality", keep_good), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("mixing", mix),
          ("sharding", shard)]

#: The fitted stages are not for SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
