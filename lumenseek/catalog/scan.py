"""Scan queries: documents and pages seen as files."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.catalog import tables as t
from lumenseek.config import Settings
from lumenseek.functions import paths as p
from lumenseek.session import shared_folder
from lumenseek.sources import files as fs, listing

MAX_SIZE = 4096
GLOBS = ("**/en/**", "**/*.html", "**/de/*", "**/?r/1*", "**/m.*/**")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a file; texts of junk lines only count as empty files."""
    docs = t.table(spark, sf, "documents")
    path = F.concat(F.lit("/ws/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"),
                    F.lit("."), F.col("lang"))
    text = F.when(F.length("text") < 20, "").otherwise(F.col("text"))
    return fs.files_from_table(docs.select(path.alias("path"), text.alias("body")), "path", "body")


def file_scan_report(spark: SparkSession, sf: str) -> DataFrame:
    return fs.scan_totals(_files(spark, sf), MAX_SIZE).select(
        "*", p.format_bytes(F.col("total_size")).alias("total_text"))


def scan_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return fs.skip_reasons(_files(spark, sf), MAX_SIZE)


def scan_indexable(spark: SparkSession, sf: str) -> DataFrame:
    kept = fs.indexable(_files(spark, sf), MAX_SIZE)
    return kept.select("file_path", "size", p.format_bytes(F.col("size")).alias("size_text"))


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return fs.scan_summary(_files(spark, sf), MAX_SIZE)


def glob_exclude(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusion of page paths under the loose and the strict reading of globs."""
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return t.table(spark, sf, "pages").select(
        "page_id", p.is_excluded(path, GLOBS).alias("loose"), p.is_excluded(path, GLOBS, strict=True).alias("strict"))


def extension_of(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return t.table(spark, sf, "pages").select(
        "page_id", p.extension(url).alias("extension"), p.is_supported(url, ("html", "htm")).alias("supported"))


def basename(spark: SparkSession, sf: str) -> DataFrame:
    back = F.replace("url", F.lit("/"), F.lit("\\"))
    return t.table(spark, sf, "pages").select(
        "page_id", p.base_name(F.col("url")).alias("name"), p.base_name(back).alias("name_backslash"))


def relative_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Web form (plain prefix) and tree form (whole folder names) of paths below /ws/src1."""
    path = F.col("file_path")
    return _files(spark, sf).select(
        "file_path", p.relative_path(path, "/ws/src1").alias("web"), p.display_path(path, "/ws/src1").alias("tree"))


LANGUAGES = ("en", "de", "fr", "es")


def _written(spark: SparkSession, sf: str) -> str:
    """Every document as a file on disk: short ones empty, some hidden, some in a folder that scans exclude."""
    root = shared_folder(spark, "tree")
    part = F.when(F.col("doc_id") % 10 == 3, "/node_modules/pkg").when(F.col("doc_id") % 10 == 5, "/.cache").when(
        F.col("doc_id") % 10 == 7, "/deep/er").otherwise("")
    path = F.concat("source", part, F.lit("/"), F.when(F.col("doc_id") % 10 == 9, ".").otherwise(""), F.lit("doc_"),
                    F.col("doc_id").cast("string"), F.lit("."), "lang")
    text = F.when(F.length("text") < 20, "").otherwise(F.col("text"))
    folder = listing.local_path(root)

    def write(batches):
        for batch in batches:
            for name, body in zip(*(c.to_pylist() for c in batch.columns)):
                target = os.path.join(folder, name)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(body.encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    os.makedirs(folder, exist_ok=True)
    t.table(spark, sf, "documents").select(path.alias("name"), text.alias("body")).where("name IS NOT NULL AND body IS NOT NULL").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
    return root


def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A real folder scanned: per reason, and for what is kept, the files, their bytes and the bytes of their decoded text."""
    files = listing.scan_folder(spark, _written(spark, sf), Settings(supported_languages=LANGUAGES))
    texts = fs.decoded(fs.indexable(files, MAX_SIZE)).select(F.octet_length("text").cast("bigint").alias("read"))
    reasons = fs.with_skip_reason(files, MAX_SIZE).groupBy("skip_reason").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    read = texts.agg(F.coalesce(F.sum("read"), F.lit(0)).alias("bytes_read"))
    return reasons.select("*", F.when(F.col("skip_reason").isNull(), F.lit(read.first().bytes_read)).alias("bytes_read"))


QUERIES = {f.__name__: f for f in (
    file_scan_report, folder_scan, scan_skip_reasons, scan_indexable, scan_summary, glob_exclude, extension_of, basename,
    relative_paths)}

# -- SQL -------------------------------------------------------------------------------

_FILES = """files AS (
  SELECT '/ws/' || source || '/doc_' || doc_id || '.' || lang AS file_path,
         CASE WHEN length(text) < 20 THEN 0 ELSE strlen(text) END AS size FROM documents)"""


def sql_bytes(size: str) -> str:
    cases = [f"WHEN {size} = 0 THEN '0 B'"]
    for i, unit in enumerate(fv.BYTE_UNITS[:4]):
        n = f"floor({size}::DOUBLE / {1024 ** i} * 100 + 0.5::DOUBLE)::BIGINT"
        cases.append(f"WHEN {size} < {1024 ** (i + 1)} THEN ({n} // 100) || '.' || lpad(({n} % 100)::VARCHAR, 2, '0') || ' {unit}'")
    return "CASE " + " ".join(cases) + " END"


_REASON = f"""CASE WHEN size > {MAX_SIZE} THEN 'File too large (' || {sql_bytes('size')} || ' > 4.00 KB)'
  WHEN size = 0 THEN 'Empty file' END"""
_REASONS = f"""{_FILES}, reasons AS (SELECT {_REASON} AS skip_reason, count(*) AS n, sum(size) AS bytes FROM files GROUP BY 1)"""
_PATH = "regexp_replace(url, '^[a-z]+://', '')"
# Loose and strict regexes of GLOBS, written out by hand.
_LOOSE = "(.[^/]*/en/.[^/]*)|(.[^/]*/[^/]*.html)|(.[^/]*/de/[^/]*)|(.[^/]*/.r/1[^/]*)|(.[^/]*/m.[^/]*/.[^/]*)"
_STRICT = "^((.*/)?en/.*|(.*/)?[^/]*\\.html|(.*/)?de/[^/]*|(.*/)?[^/]r/1[^/]*|(.*/)?m\\.[^/]*/.*)$"

ORACLES = {
    "file_scan_report": f"""WITH {_FILES}, s AS (
      SELECT count(*) FILTER (size BETWEEN 1 AND {MAX_SIZE}) AS files,
             coalesce(sum(size) FILTER (size BETWEEN 1 AND {MAX_SIZE}), 0)::BIGINT AS total_size,
             count(*) FILTER (size = 0 OR size > {MAX_SIZE}) AS skipped_files FROM files)
      SELECT *, {sql_bytes('total_size')} AS total_text FROM s""",
    "folder_scan": f"""WITH files AS (
      SELECT CASE WHEN length(text) < 20 THEN 0 ELSE strlen(text) END AS size FROM documents
      WHERE doc_id % 10 NOT IN (3, 5, 9) AND lang IN ({", ".join(f"'{x}'" for x in LANGUAGES)})),
      s AS (SELECT {_REASON} AS skip_reason, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1)
      SELECT *, CASE WHEN skip_reason IS NULL THEN bytes END AS bytes_read FROM s""",
    "scan_skip_reasons": f"WITH {_REASONS} SELECT skip_reason, n AS files FROM reasons WHERE skip_reason IS NOT NULL",
    "scan_indexable": f"""WITH {_FILES} SELECT file_path, size::BIGINT AS size, {sql_bytes('size')} AS size_text FROM files
      WHERE size BETWEEN 1 AND {MAX_SIZE}""",
    "scan_summary": f"""WITH {_REASONS}, t AS (
      SELECT coalesce(sum(n) FILTER (skip_reason IS NULL), 0)::BIGINT AS files,
             coalesce(sum(bytes) FILTER (skip_reason IS NULL), 0)::BIGINT AS total,
             coalesce(sum(n) FILTER (skip_reason IS NOT NULL), 0)::BIGINT AS skipped,
             string_agg('  - ' || skip_reason || ': ' || n, chr(10) ORDER BY '  - ' || skip_reason || ': ' || n) AS lines
      FROM reasons)
      SELECT concat_ws(chr(10), 'Found ' || files || ' indexable files', 'Total size: ' || {sql_bytes('total')},
        CASE WHEN skipped > 0 THEN 'Skipped ' || skipped || ' files:' END, lines) AS summary FROM t""",
    "glob_exclude": f"""SELECT page_id, regexp_matches({_PATH}, '{_LOOSE}') AS loose,
      regexp_matches({_PATH}, '{_STRICT}') AS strict FROM pages""",
    "extension_of": """SELECT page_id, regexp_extract(url, '[^/]\\.([^./]*)$', 1) AS extension,
      regexp_extract(url, '[^/]\\.([^./]*)$', 1) IN ('html', 'htm') AS supported FROM pages""",
    "basename": """SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[-1] AS name_backslash FROM pages""",
    "relative_paths": f"""WITH {_FILES} SELECT file_path,
      CASE WHEN starts_with(file_path, '/ws/src1') THEN substr(file_path, 10) ELSE file_path END AS web,
      CASE WHEN starts_with(file_path, '/ws/src1/') THEN substr(file_path, 10) ELSE file_path END AS tree FROM files""",
}
