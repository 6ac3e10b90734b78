"""Plans, not results: what is read, what is shuffled, where Python runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF
from lumenseek.catalog import tables as t
from lumenseek.operators import ranking
from lumenseek.plans.chunking import chunk_files
from lumenseek.sources import files as fs
from lumenseek.sources.chunk_store import ChunkStore, index_stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_is_one_stage_without_python(spark):
    files = t.table(spark, SF, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("file_path"), F.lit("ts").alias("language"), "text")
    text = plan(chunk_files(files, timestamp=0))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_keyword_is_pushed_to_the_scan(spark):
    docs = t.document_chunks(spark, SF).select("id", "text")
    text = plan(ranking.keyword_matches(docs, "the", 10))
    assert "StringContains(text,the)" in text and "TakeOrderedAndProject" in text


def test_stats_read_the_path_column_only(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), buckets=2)
    store.insert(t.search_chunks(spark, SF).withColumn("timestamp", F.lit(0)).withColumn("chunk_index_in_file", F.lit(0)))
    text = plan(index_stats(store.read()))
    assert "ReadSchema: struct<file_path:string>" in text
    one = plan(store.file_rows("/ws/src1.en"))
    assert "PartitionFilters: [isnotnull(bucket" in one and "EqualTo(file_path,/ws/src1.en)" in one


def test_listing_never_reads_content(spark, tmp_path):
    (tmp_path / "a.ts").write_text("let a = 1;")
    files = fs.list_files(spark, str(tmp_path))
    assert "content" not in plan(fs.scan_totals(files, 100))
    assert "LessThanOrEqual(length,100)" in plan(fs.decoded(fs.indexable(files, 100)))


def test_hybrid_vector_side_reads_no_text(spark, tmp_path):
    path = str(tmp_path / "t")
    t.search_chunks(spark, SF).write.parquet(path)
    chunks = spark.read.parquet(path)
    text = plan(ranking.hybrid_search(chunks, t.query_vector("x"), "the", 5, 0.1, carry=["file_path"]))
    assert "ReadSchema: struct<id:string,file_path:string,vector:array<float>>" in text
    assert "ReadSchema: struct<id:string,file_path:string,text:string>" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
