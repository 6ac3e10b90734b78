"""Rows that every corpus operator must survive, and helpers."""

from __future__ import annotations

import os

import duckdb

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, found int"
LONG = " ".join(f"word{i % 977} thing{i % 13}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", None, 0.5, "x", 1), (2, "", "en", "a", 0, None, None, None), (3, "   \n\t ", None, "a", 6, 0.1, "y", 2),
    (4, "one", "en", None, 3, 0.2, "z", 3), (5, "!!! ??? ...", None, None, 11, None, None, 4),
    (6, LONG, "en", "a", len(LONG), 0.3, "x", 5), (7, LONG + " end", "en", "b", None, 0.3, "x", 5),
    (8, "Zażółć gęślą jaźń über straße", "de", "b", 29, None, None, None), (9, "日本語の文章です。", None, "c", 9, None, None, None),
    (10, "the same text in five words", "en", "a", 27, None, None, None),
    (10, "the same text in five words", "en", "a", 27, None, None, None),
    (11, "The SAME text, in five words!", "en", "b", 29, None, None, None),
    (None, "no id here at all", "fr", "c", 17, None, None, None), (12, None, None, None, None, None, None, None),
    (-5, "a <|endoftext|> b don't 123 \x00 \U0001f600", "es", "c", 30, None, None, None),
]


def edge_documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def edge_labels(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (4, 0, 0), (6, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def duck(sf: str):
    connection = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        path = os.path.join(sf, f)
        connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return connection


def words(text: str | None) -> list[str]:
    import re
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
