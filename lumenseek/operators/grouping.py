"""Views over a result list: per-file groups and their counts.

Inputs are result lists of a search, at most ``limit`` rows, so collecting a
file's results into an array is bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lumenseek.functions import scoring
from lumenseek.functions.paths import display_path, relative_path
from lumenseek.functions.text import preview, tree_preview, type_icon


def by_file(results: DataFrame, root: str = "", *, position: str = "rerank_position") -> DataFrame:
    """File groups with their chunks by score, files by average rounded score.

    Equal scores keep the order of the result list, equal averages the order
    in which files first appear in it.
    """
    chunk = F.struct(
        (-F.col("score")).alias("neg_score"), F.col(position).alias("position"), "id",
        "start_line", "end_line", "type", "language", "similarity", "score", "low_relevance",
        preview(F.col("text")).alias("preview"))
    grouped = results.groupBy("file_path").agg(
        F.avg("score").alias("avg_score"), F.min(position).alias("first_position"),
        F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return grouped.withColumn(
        "relative_path", relative_path(F.col("file_path"), root) if root else F.col("file_path")
    ).orderBy(F.desc("avg_score"), "first_position")


def tree(results: DataFrame, root: str = "", types=None, *, position: str = "rerank_position") -> DataFrame:
    """Tree form: optional type filter, chunks by similarity, whole-percent average."""
    if types:
        results = results.where(F.col("type").isin(*types))
    chunk = F.struct(
        (-F.col("similarity")).alias("neg_similarity"), F.col(position).alias("position"), "id",
        tree_preview(F.col("text")).alias("label"),
        F.format_string("Lines %d-%d", "start_line", "end_line").alias("description"),
        type_icon(F.col("type")).alias("icon"),
        scoring.result_tooltip(F.col("similarity"), F.col("type"), F.col("start_line"),
                               F.col("end_line")).alias("tooltip"))
    n = F.count(F.lit(1))
    grouped = results.groupBy("file_path").agg(
        F.avg("score").alias("avg_score"), F.min(position).alias("first_position"), n.alias("results"),
        F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return grouped.select(
        "file_path",
        (display_path(F.col("file_path"), root) if root else F.col("file_path")).alias("label"),
        F.concat(F.floor(F.col("avg_score") + 0.5).cast("string"), F.lit("%")).alias("description"),
        F.concat(F.col("file_path"), F.lit("\n"), scoring.plural(F.col("results"), "result")).alias("tooltip"),
        "avg_score", "first_position", "results", "chunks",
    ).orderBy(F.desc("avg_score"), "first_position")


def view_counts(results: DataFrame, types=None) -> DataFrame:
    """Number of results and files of the current view, after its type filter."""
    if types:
        results = results.where(F.col("type").isin(*types))
    return results.agg(F.count(F.lit(1)).alias("result_count"),
                       F.count_distinct("file_path").alias("file_count"))
