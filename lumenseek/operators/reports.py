"""Reports over chunks and embeddings: histograms, averages, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenseek import fixed_values as fv
from lumenseek.functions import scoring
from lumenseek.functions.text import fixed_decimals
from lumenseek.functions.vector import has_vector


def type_histogram(chunks: DataFrame) -> DataFrame:
    """Chunks per type, most first, with a bar of one cell per five (rounded up)."""
    counts = chunks.groupBy("type").agg(F.count(F.lit(1)).alias("chunks"))
    bar = F.repeat(F.lit("█"), F.ceil(F.col("chunks") / fv.HISTOGRAM_CELL).cast("int"))
    return counts.withColumn("bar", bar).orderBy(F.desc("chunks"), "type")


def chunk_averages(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files, chunks and chunks per file; files without chunks count as well."""
    n_files = files.agg(F.count(F.lit(1)).alias("files"))
    n_chunks = chunks.agg(F.count(F.lit(1)).alias("chunks"))
    # Two one-row aggregates side by side.
    both = n_files.unionByName(n_chunks, allowMissingColumns=True).agg(
        F.max("files").alias("files"), F.max("chunks").alias("chunks"))
    return both.withColumn("average", fixed_decimals(F.try_divide(F.col("chunks"), F.col("files")), 1))


def index_report(embedded: DataFrame) -> DataFrame:
    """One row about an index run: files, chunks, how many got a vector, success rate."""
    ok = has_vector(F.col("vector"))
    totals = embedded.agg(
        F.count_distinct("file_path").alias("files"), F.count(F.lit(1)).alias("chunks"),
        F.count_if(ok).alias("successful_chunks"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed_chunks"))
    return totals.withColumn("success_rate", scoring.success_rate_text(
        F.col("successful_chunks"), F.col("chunks")))


def token_usage(embedded: DataFrame) -> DataFrame:
    """Tokens a hosted service charged for an embedding run."""
    return embedded.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens_used"))


def write_chunk_dump(chunks: DataFrame, path: str) -> None:
    """The chunks as JSON lines, one file per task, beside a one-row summary."""
    chunks.drop("vector").write.mode("overwrite").json(f"{path}/chunks")
    summary = type_histogram(chunks).agg(
        F.sum("chunks").alias("total_chunks"),
        F.map_from_entries(F.collect_list(F.struct("type", "chunks"))).alias("chunks_by_type"))
    files = chunks.agg(F.count_distinct("file_path").alias("files"))
    # The aggregate of 21 types at most and a count: both one row.
    merged = summary.unionByName(files, allowMissingColumns=True).agg(
        F.max("total_chunks").alias("total_chunks"), F.first("chunks_by_type", ignorenulls=True).alias("chunks_by_type"),
        F.max("files").alias("files_processed"))
    merged.withColumn("average_chunks_per_file", fixed_decimals(
        F.try_divide(F.col("total_chunks"), F.col("files_processed")), 1)).withColumn(
            "timestamp", F.current_timestamp()).write.mode("overwrite").json(f"{path}/metadata")
