from __future__ import annotations

import logging

from pyspark.sql import functions as F

from lumenseek.operators import reports
from lumenseek.plans import messages
from lumenseek.plans.indexing import IndexReport
from lumenseek.sources import files as fs
from lumenseek.sources.chunk_store import IndexStats


def test_texts():
    assert messages.progress_text(1, 8) == "Indexing... 13%"
    assert messages.ready_text() == "Ready" and messages.ready_text(12345) == "Ready | 12,345 chunks"
    assert messages.stats_text(IndexStats(3, 2, 1572864)).endswith("Storage size: 1.50 MB")
    text = messages.report_text(IndexReport(True, 2, 8, 7, 1, 1500))
    assert text == "Files: 2\nChunks: 7/8 (87.5%)\nDuration: 1.5s\n1 chunks failed to embed"
    assert messages.report_text(IndexReport(False, 0, 0, 0, 0, 0, ["no"])) == "Indexing failed: no"


def test_log_line():
    record = logging.LogRecord("Store", logging.WARNING, "f", 1, "lost %d", (3,), None)
    record.details = [{"a": 1}]
    line = messages.LineFormatter().format(record)
    assert line.startswith("[") and line.endswith('Z] [WARN] [Store] lost 3 [{"a": 1}]')


def test_sample_of_files(spark):
    names = [f"/ws/f{i:03}.ts" for i in range(120)] + ["/ws/x.min.js", "/ws/vendor/a.ts", "/ws/jest.config.js", "/ws/a.css"]
    df = spark.createDataFrame([(n,) for n in names], "file_path string")
    got = [r[0] for r in fs.sample_files(df, "/ws").collect()]
    assert got == names[:100]


def test_averages_token_usage_and_empty_runs(spark):
    df = spark.createDataFrame([("a", 3, [1.0]), ("b", None, []), ("a", 4, None)],
                               "file_path string, tokens_used bigint, vector array<float>")
    assert reports.token_usage(df).first()[0] == 7
    assert tuple(reports.index_report(df).first()) == (2, 3, 1, 2, "33.3")
    assert tuple(reports.index_report(df.where("false")).first()) == (0, 0, 0, 0, None)
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    assert tuple(reports.chunk_averages(files, df).first()) == (3, 3, "1.0")
    bars = reports.type_histogram(spark.range(11).select(F.when(F.col("id") < 6, "function").otherwise("css").alias("type")))
    assert [tuple(r) for r in bars.collect()] == [("function", 6, "██"), ("css", 5, "█")]
