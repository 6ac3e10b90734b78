"""Files as a DataFrame: discovery, exclusion, size rules, decoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.config import Settings
from lumenseek.functions import paths as p
from lumenseek.sources import listing

TOO_LARGE, EMPTY, NO_ACCESS = "File too large", "Empty file", "File access error"


def include_glob(extensions: Sequence[str]) -> str:
    return "*.{" + ",".join(extensions) + "}"


def list_files(spark: SparkSession, root: str, settings: Settings = Settings()) -> DataFrame:
    """Files below ``root`` by extension, without dot-files and excluded folders.

    ``content`` is only read by plans that use it; the listing itself and any
    filter on ``size`` never open a file. Spark's file sources leave out
    zero-byte files, so those are skipped here without being counted;
    ``listing.scan_folder`` counts them where tasks can open the folder.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", include_glob(settings.supported_languages)).load(root))
    # The source reports URIs with escapes; show paths as the file system spells them.
    plain = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
    below = p.relative_path(F.col("file_path"), root.rstrip("/"))
    kept = (~below.rlike(r"(^|/)\.") & ~p.is_excluded(below, settings.exclude_patterns, strict=True)
            & p.is_supported(F.col("file_path"), settings.supported_languages))
    return files.select(plain.alias("file_path"), F.col("length").alias("size"), "content").where(kept)


def sample_files(files: DataFrame, root: str = "") -> DataFrame:
    """The first 100 files worth a look when trying out the chunker.

    Only those leave the listing, which is the point of a sample; the index
    build never uses it.
    """
    path = F.col("file_path")
    below = p.relative_path(path, root.rstrip("/")) if root else path
    wanted = p.is_supported(path, fv.SAMPLE_EXTENSIONS) & ~p.is_excluded(below, fv.SAMPLE_EXCLUDE_GLOBS, strict=True)
    return files.where(wanted).orderBy("file_path").limit(fv.SAMPLE_FILES)


def files_from_table(df: DataFrame, path: str, text: str) -> DataFrame:
    """A table of paths and texts seen as files.

    For code bases of many millions of small files: pack them into a table
    once instead of listing them on the driver for every run.
    """
    return df.select(F.col(path).alias("file_path"),
                     F.octet_length(F.col(text)).cast("long").alias("size"), F.col(text).alias("text"))


def skip_reason(size: Column, max_size: int) -> Column:
    """Why a file is left out, or NULL; a file of exactly ``max_size`` bytes stays."""
    large = F.concat(F.lit(f"{TOO_LARGE} ("), p.format_bytes(size), F.lit(" > "),
                     p.format_bytes(F.lit(max_size)), F.lit(")"))
    return (F.when(size.isNull(), NO_ACCESS).when(size > max_size, large).when(size == 0, EMPTY))


def with_skip_reason(files: DataFrame, max_size: int) -> DataFrame:
    return files.withColumn("skip_reason", skip_reason(F.col("size"), max_size))


def indexable(files: DataFrame, max_size: int) -> DataFrame:
    """The files to index. Written as a plain size range, which a file source pushes down."""
    return files.where((F.col("size") > 0) & (F.col("size") <= max_size))


def scan_totals(files: DataFrame, max_size: int) -> DataFrame:
    """One row: kept files, their bytes, skipped files."""
    kept = skip_reason(F.col("size"), max_size).isNull()
    return files.agg(
        F.count_if(kept).alias("files"), F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("total_size"),
        F.count_if(~kept).alias("skipped_files"))


def skip_reasons(files: DataFrame, max_size: int) -> DataFrame:
    return with_skip_reason(files, max_size).where(F.col("skip_reason").isNotNull()).groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("files"))


def scan_summary(files: DataFrame, max_size: int) -> DataFrame:
    """The summary text of a scan.

    Reasons are counted before their lines are joined. Too-large reasons show
    the size to two decimals, so there are only as many as such numbers.
    """
    reasons = with_skip_reason(files, max_size).groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    kept, skipped = F.col("skip_reason").isNull(), F.col("skip_reason").isNotNull()
    lines = F.array_sort(F.collect_list(F.when(skipped, F.concat(
        F.lit("  - "), "skip_reason", F.lit(": "), F.col("n").cast("string")))))
    totals = reasons.agg(
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("files"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(skipped, F.col("n"))), F.lit(0)).alias("skipped"), lines.alias("lines"))
    return totals.select(F.concat_ws(
        "\n",
        F.concat(F.lit("Found "), F.col("files").cast("string"), F.lit(" indexable files")),
        F.concat(F.lit("Total size: "), p.format_bytes(F.col("total"))),
        F.when(F.col("skipped") > 0, F.concat(F.lit("Skipped "), F.col("skipped").cast("string"), F.lit(" files:"))),
        F.when(F.col("skipped") > 0, F.array_join("lines", "\n"))).alias("summary"))


def decoded(files: DataFrame) -> DataFrame:
    """UTF-8 text of files, bad bytes replaced, with the language of the path.

    Files with neither ``content`` nor ``text`` are those of ``listing.scan_folder`` and read in the tasks.
    """
    if listing.needs_reading(files):
        files = listing.with_contents(files)
    text = F.make_valid_utf8(F.col("content").cast("string")) if "content" in files.columns else F.col("text")
    return files.select("file_path", F.lower(p.extension(F.col("file_path"))).alias("language"), text.alias("text"))
