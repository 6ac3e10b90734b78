"""Batch numbers over a whole table, and merging retried rows back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lumenseek.session import shared_folder

#: Rows that one task numbers, on average.
ROWS_PER_SLICE = 50_000


def global_index(df: DataFrame, key: str, *, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """0-based position of every row in the order of a unique key.

    A window over the whole table would sort it in one task. Here rows are
    range-partitioned by the key into slices, and written once to the shared
    folder so that a task re-run sees the same slices. Rows are counted per
    slice and numbered inside their slice, and the rows before the slice are
    added; only the counts, one row per slice, meet in one task.
    """
    spark = df.sparkSession
    slices = max(1, -(-df.count() // rows_per_slice))
    folder = shared_folder(spark, "sliced")
    df.repartitionByRange(slices, key).withColumn("_slice", F.spark_partition_id()).write.parquet(folder)
    sliced = spark.read.parquet(folder)
    counts = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(key)) - 1
    numbered = sliced.withColumn("_inside", inside).join(offsets, "_slice")
    return numbered.withColumn("position", F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")


def assign_batches(df: DataFrame, key: str, batch_size: int = 32) -> DataFrame:
    """Batch number and place inside the batch, in key order."""
    numbered = global_index(df, key)
    return numbered.withColumn("batch", F.floor(F.col("position") / batch_size).cast("long")).withColumn(
        "start_index", F.col("batch") * batch_size)


def split_failed(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a vector, and rows whose embedding failed."""
    failed = F.coalesce(F.size("vector"), F.lit(0)) <= 0
    return embedded.where(~failed), embedded.where(failed)


def merge_retried(original: DataFrame, retried: DataFrame, key: str = "id") -> DataFrame:
    """Put retried vectors in place of failed ones; a retry that failed changes nothing."""
    fixed = retried.where(F.size("vector") > 0).select(key, F.col("vector").alias("_retried"))
    merged = original.join(fixed, key, "left")
    was_failed = F.coalesce(F.size("vector"), F.lit(0)) <= 0
    return merged.withColumn(
        "vector", F.when(was_failed & F.col("_retried").isNotNull(), F.col("_retried"))
        .otherwise(F.col("vector"))).drop("_retried")


def embedding_counts(embedded: DataFrame) -> DataFrame:
    ok = F.coalesce(F.size("vector"), F.lit(0)) > 0
    return embedded.agg(F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("failure_count"))
