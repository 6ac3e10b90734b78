"""Folder scans by tasks, and stages that survive failing rows."""

from __future__ import annotations

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lumenseek.config import Settings
from lumenseek.plans.engine import CodeSearch
from lumenseek.plans.isolation import TooManyFailures, isolated, reason
from lumenseek.sources import files as fs, listing


@pytest.fixture
def tree(tmp_path):
    for name, text in {
        "a.ts": "let a = 1;", "empty.ts": "", "big.ts": "x" * 2000, "src/deep/er/b.ts": "let b = 'é';", "src/c%20 d+e.ts": "let c;",
        "src/.hid.ts": "no", ".git/x.ts": "no", "node_modules/p/q/r.ts": "no", "src/node_modules/s.ts": "no", "notes.txt": "no",
        "src/dist.ts": "let d;", "UPPER.TS": "let u;",
    }.items():
        path = tmp_path / "ws" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    os.symlink(tmp_path / "ws" / "a.ts", tmp_path / "ws" / "link.ts")
    os.symlink(tmp_path / "ws" / "src", tmp_path / "ws" / "linked")
    return str(tmp_path / "ws")


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_scan_sees_empty_files_and_skips_what_is_excluded(spark, tree, prefix):
    files = listing.scan_folder(spark, prefix + tree + "/")
    found = {r.file_path[len(tree):]: r.size for r in files.collect()}
    assert found == {"/a.ts": 10, "/empty.ts": 0, "/big.ts": 2000, "/src/deep/er/b.ts": 13, "/src/c%20 d+e.ts": 6, "/src/dist.ts": 6,
                     **({"/UPPER.TS": 6} if "/UPPER.TS" in found else {})}
    assert {r.skip_reason: r.files for r in fs.skip_reasons(files, 1024).collect()} == {
        "Empty file": 1, "File too large (1.95 KB > 1.00 KB)": 1}
    texts = {r.file_path[len(tree):]: r.text for r in fs.decoded(fs.indexable(files, 1024)).collect()}
    assert texts["/src/deep/er/b.ts"] == "let b = 'é';" and "/empty.ts" not in texts


def test_what_cannot_be_read_has_no_size(spark, tree, monkeypatch):
    rows = [r for b in listing._entries(iter([listing.pa.RecordBatch.from_arrays(
        [listing.pa.array([tree + "/gone", tree])], ["path"])])) for r in b.to_pylist()]
    assert {"path": tree + "/gone", "kind": "file", "size": None} in rows
    assert tree + "/link.ts" not in {r["path"] for r in rows}
    with pytest.raises(FileNotFoundError):
        listing.scan_folder(spark, tree + "/gone")
    with pytest.raises(ValueError):
        listing.scan_folder(spark, "hdfs:///x")


def test_file_that_goes_between_listing_and_reading_is_an_error_row(spark, tree, tmp_path):
    engine = CodeSearch(spark, str(tmp_path / "index"), Settings(embedding_provider="hash", max_file_size=1024), buckets=2)
    files = engine.folder_files(tree)
    os.remove(tree + "/a.ts")
    report = engine.index(files)
    assert report.success and report.error_count == 1
    assert [tuple(r) for r in engine.store.errors().collect()] == [
        (tree + "/a.ts", "chunking", f"Failed to chunk {tree}/a.ts: File access error")]
    assert {r.file_path[len(tree):] for r in engine.store.read().collect()} >= {"/src/deep/er/b.ts", "/src/dist.ts"}


def test_failing_rows_are_found_by_halving(spark):
    rows = spark.range(300).select(F.concat(F.lit("f"), "id").alias("k"), "id").repartition(4)
    bad = F.col("id").isin(7, 200)
    work = lambda df: df.select("k", F.when(bad, F.raise_error(F.concat(F.lit("no: "), "k"))).otherwise("fine").alias("v"))
    done, errors = isolated(rows, work, "k")
    assert done.count() == 298 and done.columns == ["k", "v"]
    assert sorted(map(tuple, errors.collect())) == [("f200", "no: f200"), ("f7", "no: f7")]
    whole, none = isolated(rows, lambda df: df.select("k"), "k")
    assert whole.count() == 300 and none.count() == 0 and none.columns == ["k", "error"]


def test_halves_read_their_own_rows_only(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(k):
        read.add(1)
        return k

    rows = spark.range(4096).repartition(4).select(F.concat(F.lit("f"), "id").alias("k"), "id").withColumn("text", counted.asNondeterministic()("k"))
    bad = F.col("id").isin(7, 2000, 4000)
    work = lambda df: df.select("text", F.when(bad, F.raise_error(F.lit("no"))).otherwise("fine").alias("v"))
    done, errors = isolated(rows, work, "k")
    assert done.count() == 4093 and sorted(r.k for r in errors.collect()) == ["f2000", "f4000", "f7"]
    # Twelve halvings that each read everything for three keys are more than twice as many.
    assert read.value < 24 * 4096


def test_python_failures_and_repeated_keys(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, n int")

    @F.udf("int")
    def odd(n):
        if n == 2:
            raise ValueError("two is bad")
        return n

    done, errors = isolated(rows, lambda df: df.select("k", odd("n").alias("n")), "k")
    # A key fails with all its rows.
    assert sorted((r.n for r in done.collect())) == [3, 4]
    assert [tuple(r) for r in errors.collect()] == [("a", "two is bad")]


def test_what_is_no_row_s_fault_is_raised(spark):
    rows = spark.range(8).select(F.col("id").cast("string").alias("k"))
    with pytest.raises(AnalysisException):
        isolated(rows, lambda df: df.select("nothing"), "k")
    with pytest.raises(TooManyFailures):
        isolated(rows, lambda df: df.select("k", F.raise_error(F.lit("down")).cast("string").alias("v")), "k", most_failures=2)
    with pytest.raises(Exception, match="down"):
        isolated(rows.limit(0), lambda df: df.groupBy().count().select(F.raise_error(F.lit("down")).cast("string").alias("v")), "k")


def test_reason_is_the_innermost_message():
    assert reason(Exception("Job aborted: Lost task: org.x.SparkRuntimeException: [USER_RAISED_EXCEPTION] boom SQLSTATE: P0001\n\tat x")) == "boom"
    assert reason(ValueError("plain")) == "plain"
