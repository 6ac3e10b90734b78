"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_queries import plain  # noqa: E402
from lumenseek.catalog import tables  # noqa: E402

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        connection.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return connection


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(plain([r[c] for c in cols]) for r in df.collect())
    if name not in ORACLES:
        assert mine
        return
    got = db.execute(ORACLES[name])
    heads = [d[0] for d in got.description]
    assert sorted(heads) == cols
    theirs = sorted(plain([r[heads.index(c)] for c in cols]) for r in got.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_source_files_of_one_row_group_are_dealt_to_every_core(spark):
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert tables.table(spark, SF, "documents").rdd.getNumPartitions() >= cores
        rows = tables.source_files(spark, SF).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) >= cores and max(r["count"] for r in rows) <= 2 * 200 / cores
