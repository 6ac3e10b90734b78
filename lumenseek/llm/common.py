"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek.session import shared_folder, ship_package


#: Most texts that a Python worker and its executor hold at a time; long ones are few.
TEXTS_PER_BATCH = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds if isinstance(doc_id, str)
                      else F.crc32(doc_id.cast("string")) % folds, F.lit(0))


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the cluster's shared folder and read back: survives lost executors and cuts lineage."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """At most ``most`` labelled documents with their label: those with the smallest hash of the id.

    ``labels`` may repeat a document; the smaller label counts. Only ids and
    labels are ranked, and the bounded list is then joined to the texts.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).where(keep))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambda variables are values, not expressions."""
    return F.get(F.transform(F.array(value), use), 0)


def ready(spark: SparkSession) -> None:
    """Before Python runs in tasks: the package is there, and Arrow batches of whole texts stay small."""
    ship_package(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= TEXTS_PER_BATCH:
        spark.conf.set(rows, TEXTS_PER_BATCH)
