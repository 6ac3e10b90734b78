"""Schemas of the chunk table and of the structs that flow between operators."""

from __future__ import annotations

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType(), containsNull=False)

#: One row per code chunk, as stored. ``vector`` is never null in the table.
CHUNK_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("start_line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("chunk_index_in_file", T.IntegerType()),
    T.StructField("vector", VECTOR),
])

CHUNK_COLUMNS = [f.name for f in CHUNK_SCHEMA.fields if f.name != "vector"]

#: One embedding call's outcome; an empty vector marks a failed text.
EMBEDDED = T.StructType([
    T.StructField("vector", VECTOR),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("error", T.StringType()),
])
