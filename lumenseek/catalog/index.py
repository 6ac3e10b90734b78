"""Index queries: store mutations, reports, batching, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek.catalog import tables as t
from lumenseek.catalog.chunks import _TS_FILES, sql_chunks
from lumenseek.catalog.text import sql_trim
from lumenseek.config import Settings
from lumenseek.functions import scoring, vector as vec
from lumenseek.operators import batching, reports
from lumenseek.plans.chunking import chunk_files, fallback_chunks
from lumenseek.plans.indexing import build_index, run_errors
from lumenseek.providers.embedding import HashProvider
from lumenseek.session import shared_folder
from lumenseek.sources import files as fs
from lumenseek.sources.chunk_store import ChunkStore, index_stats as stats_of, valid_rows
from lumenseek.streaming import change_feed as feed

FAILED_LABEL = 3
BATCH = 32
PIECE_LINES = 10
FEED_BATCHES = 3
#: A provider in trouble cannot embed chunks of this file.
HARD_FILE = "doc_7.ts"


class FailingProvider(HashProvider):
    """Raises for every request that holds a hard text, so that its texts are tried one by one."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        # Identifiers reach a provider in parts.
        if any(f" {HARD_FILE.replace('_', ' ')} " in text for text in texts):
            raise RuntimeError("hard text")
        return super().embed(texts)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(t.source_files(spark, sf), timestamp=0)


def type_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.type_histogram(_chunks(spark, sf))


def chunk_averages(spark: SparkSession, sf: str) -> DataFrame:
    return reports.chunk_averages(t.source_files(spark, sf), _chunks(spark, sf))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats_of(t.document_chunks(spark, sf))


def _embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with vectors; those of one label count as failed."""
    vectors = t.table(spark, sf, "embeddings")
    failed = F.col("label") == FAILED_LABEL
    vectors = vectors.select(F.col("vec_id").alias("doc_id"), F.when(
        failed, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("vector"))
    return t.document_chunks(spark, sf).join(vectors, "doc_id")


def index_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.index_report(_embedded(spark, sf))


def index_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of a build whose failed vectors have a reason and which meets French files it cannot chunk."""
    embedded = _embedded(spark, sf).withColumn("embed_error", F.when(F.size("vector") == 0, "empty vector"))
    sources = t.document_chunks(spark, sf).select("file_path", F.when(F.col("language") == "fr", "fr").otherwise("ts").alias("language"))
    return run_errors(sources, embedded)


def isolated_errors(spark: SparkSession, sf: str) -> DataFrame:
    """A whole build in which chunking raises for the largest files and the provider for some texts.

    The errors it leaves, and how many files are in the index all the same.
    """
    docs = t.table(spark, sf, "documents")
    files = docs.select(F.concat(F.lit("/ws/doc_"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("file_path"), "text")
    largest = files.agg(F.max(F.length("text"))).first()[0]
    path = F.col("file_path")

    def chunker(sources: DataFrame) -> DataFrame:
        bad = F.when(F.length("text") == largest, F.raise_error(F.lit("no way to chunk this"))).otherwise(F.col("text"))
        return fallback_chunks(sources.withColumn("text", bad), PIECE_LINES)

    store = ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    settings = Settings(max_file_size=1048576, embedding_provider="hash")
    build_index(spark, fs.files_from_table(files, "file_path", "text"), store, FailingProvider(t.DIMENSIONS), settings,
                chunker=chunker, tries=1)
    indexed = store.read().select("file_path").distinct().groupBy().count()
    return store.errors().select(path, "stage", "error").unionByName(
        indexed.select(F.lit(None).cast("string").alias("file_path"), F.lit("indexed").alias("stage"),
                       F.col("count").cast("string").alias("error")))


def embedding_counts(spark: SparkSession, sf: str) -> DataFrame:
    return batching.embedding_counts(_embedded(spark, sf))


def valid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return valid_rows(_embedded(spark, sf)).select("id", "vector")


def failed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return batching.split_failed(_embedded(spark, sf))[1].select("id", "file_path")


def merge_retry(spark: SparkSession, sf: str) -> DataFrame:
    """Failed chunks get the vector of a retry that again fails for odd documents."""
    embedded = _embedded(spark, sf)
    _, failed = batching.split_failed(embedded)
    again = F.when(F.col("doc_id") % 2 == 0, F.array_repeat(F.lit(0.5).cast("float"), 4)).otherwise(
        F.array().cast("array<float>"))
    merged = batching.merge_retried(embedded, failed.withColumn("vector", again))
    return merged.select("id", F.size("vector").alias("size"), F.get("vector", F.lit(0)).alias("first"))


def wrong_dimensions(spark: SparkSession, sf: str) -> DataFrame:
    return _embedded(spark, sf).where(vec.wrong_dimension(F.col("vector"), t.DIMENSIONS)).select(
        "id", F.size("vector").alias("size"))


def batch_assignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select("doc_id")
    return batching.assign_batches(docs, "doc_id", BATCH)


def progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress figures as if every document were one step of an index run."""
    docs = t.table(spark, sf, "documents").select("doc_id")
    steps = batching.global_index(docs, "doc_id").withColumn("current", F.col("position") + 1)
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    # One row beside every step: a one-row scalar, not a growing side.
    steps = steps.withColumn("total", F.lit(total.first().total))
    current, n = F.col("current"), F.col("total")
    percent = scoring.percentage(current, n)
    return steps.select(
        "doc_id", percent.alias("percent"), scoring.band_percentage("chunking", current / n).alias("chunking"),
        scoring.band_percentage("embedding", percent / 100).alias("embedding"),
        scoring.processing_seconds(current, BATCH).alias("seconds"))


# -- mutations -----------------------------------------------------------------------------


def _table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.search_chunks(spark, sf).withColumn("timestamp", F.lit(0).cast("long")).withColumn(
        "chunk_index_in_file", F.lit(0))


def _filled_store(spark: SparkSession, sf: str) -> ChunkStore:
    store = ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    store.insert(_table_rows(spark, sf))
    return store


_STORED = ["id", "file_path", "start_line", "end_line", "text", "type", "language", "vector"]


def insert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    store = ChunkStore(spark, shared_folder(spark, "store"), buckets=8)
    embedded = _embedded(spark, sf).withColumn("timestamp", F.lit(0)).withColumn("chunk_index_in_file", F.lit(0))
    store.insert(embedded)
    return store.read().select(*_STORED)


def delete_file(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled_store(spark, sf)
    gone = t.document_chunks(spark, sf).select("file_path").where(
        F.col("file_path").rlike(r"/src(1|12)\.(en|fr)$"))
    store.delete_files(gone)
    return store.read().select(*_STORED)


def upsert_file(spark: SparkSession, sf: str) -> DataFrame:
    """Files of sources ending in 7 are replaced; one of their languages comes back empty."""
    store = _filled_store(spark, sf)
    changed = _table_rows(spark, sf).where(F.col("file_path").rlike(r"7\.[a-z]+$"))
    new = changed.where(F.col("language") != "de").withColumn("text", F.concat(F.lit("// updated "), "id"))
    # Staged first: the new rows must not depend on the table they replace.
    store.upsert(changed.select("file_path"), new)
    return store.read().select(*_STORED)


# -- change feed -------------------------------------------------------------------------------

def _changes(events: DataFrame) -> DataFrame:
    """Events as changes of one file per user; an error event deletes the file."""
    op: Column = F.when(F.col("event_type") == "error", feed.DELETE).otherwise("write")
    return events.select(
        F.concat(F.lit("/ws/user_"), F.col("user_id").cast("string"), F.lit(".ts")).alias("file_path"), "ts",
        F.col("event_id").alias("change_id"), op.alias("op"))


def latest_change_per_file(spark: SparkSession, sf: str) -> DataFrame:
    latest = feed.latest_changes(_changes(t.table(spark, sf, "events")))
    return latest.select("file_path", "change_id", "op")


def stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All events streamed into a store in batches out of order; what is left is the last state of every file."""
    folder = shared_folder(spark, "feed")
    store = ChunkStore(spark, f"{folder}/store", buckets=8)
    known = t.table(spark, sf, "events")
    text = F.concat(F.lit("export const v"), F.col("event_id").cast("string"), F.lit(" = '"), "event_type", F.lit("';\n"))
    texts = known.select(F.col("event_id").alias("change_id"), text.alias("text"))
    # Every batch has early and late changes of every file.
    known.repartition(FEED_BATCHES, "event_id").write.parquet(f"{folder}/inbox")
    events = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/inbox")
    query = feed.start_change_feed(
        _changes(events), store, HashProvider(t.DIMENSIONS), f"{folder}/checkpoint", available_now=True,
        load_text=lambda batch: batch.join(texts, "change_id"))
    query.awaitTermination()
    return store.read().select("id", "file_path", "start_line", "end_line", "text", "type",
                               F.size("vector").alias("dimensions"))


QUERIES = {f.__name__: f for f in (
    type_histogram, chunk_averages, index_stats, index_report, index_errors, embedding_counts, valid_chunks, failed_chunks,
    merge_retry, isolated_errors, wrong_dimensions, batch_assignment, progress, insert_chunks, delete_file, upsert_file,
    latest_change_per_file, stream_upsert)}

# -- SQL --------------------------------------------------------------------------------------

_EMBEDDED = f"""{t.SQL_DOCUMENT_CHUNKS},
embedded AS (
  SELECT c.*, CASE WHEN e.label = {FAILED_LABEL} THEN []::FLOAT[] ELSE e.embedding END AS vector
  FROM document_chunks c JOIN embeddings e ON e.vec_id = c.doc_id)"""
_COLS = ", ".join(_STORED)
_LATEST = """latest AS (
  SELECT '/ws/user_' || user_id || '.ts' AS file_path, event_id AS change_id,
         CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op,
         'export const v' || event_id || ' = ''' || event_type || ''';' || chr(10) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1)"""

ORACLES = {
    "type_histogram": f"""{sql_chunks(_TS_FILES)}
      SELECT type, count(*) AS chunks, repeat('█', ceil(count(*) / 5)::INTEGER) AS bar FROM chunk_rows GROUP BY type""",
    "chunk_averages": f"""{sql_chunks(_TS_FILES)}, n AS (SELECT (SELECT count(*) FROM documents) AS files,
        (SELECT count(*) FROM chunk_rows) AS chunks), x AS (SELECT *, floor(chunks / files * 10 + 0.5)::BIGINT AS k FROM n)
      SELECT files, chunks, (k // 10) || '.' || (k % 10) AS average FROM x""",
    "index_stats": f"""WITH {t.SQL_DOCUMENT_CHUNKS} SELECT count(*) AS chunk_count,
      count(DISTINCT file_path) AS file_count FROM document_chunks""",
    "index_report": f"""WITH {_EMBEDDED}, x AS (SELECT count(DISTINCT file_path) AS files, count(*) AS chunks,
        count(*) FILTER (len(vector) > 0) AS successful_chunks, count(*) FILTER (len(vector) = 0) AS failed_chunks FROM embedded),
      y AS (SELECT *, floor(successful_chunks / chunks * 100 * 10 + 0.5)::BIGINT AS k FROM x)
      SELECT files, chunks, successful_chunks, failed_chunks, (k // 10) || '.' || (k % 10) AS success_rate FROM y""",
    "index_errors": f"""WITH {_EMBEDDED}
      SELECT file_path, 'chunking' AS stage, 'Failed to chunk ' || file_path || ': Unsupported file extension: fr' AS error
      FROM document_chunks WHERE language = 'fr'
      UNION ALL SELECT file_path, 'embedding', 'Failed to embed ' || id || ': empty vector' FROM embedded WHERE len(vector) = 0""",
    "isolated_errors": f"""WITH source_files AS (SELECT '/ws/doc_' || doc_id || '.ts' AS file_path, text FROM documents WHERE text <> ''),
      big AS (SELECT file_path FROM source_files WHERE length(text) = (SELECT max(length(text)) FROM source_files)),
      l AS (SELECT file_path, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line
            FROM source_files WHERE file_path NOT IN (SELECT file_path FROM big)),
      good AS (SELECT file_path, file_path || ':' || (min(i) + 1) || '-' || (max(i) + 1) AS id FROM l
               GROUP BY file_path, i // {PIECE_LINES} HAVING bool_or({sql_trim('line')} <> ''))
      SELECT file_path, 'chunking' AS stage, 'Failed to chunk ' || file_path || ': no way to chunk this' AS error FROM big
      UNION ALL SELECT file_path, 'embedding', 'Failed to embed ' || id || ': hard text' FROM good WHERE ends_with(file_path, '/{HARD_FILE}')
      UNION ALL SELECT NULL, 'indexed', count(DISTINCT file_path)::VARCHAR FROM good WHERE NOT ends_with(file_path, '/{HARD_FILE}')""",
    "embedding_counts": f"""WITH {_EMBEDDED} SELECT count(*) FILTER (len(vector) > 0) AS success_count,
      count(*) FILTER (len(vector) = 0) AS failure_count FROM embedded""",
    "valid_chunks": f"WITH {_EMBEDDED} SELECT id, vector FROM embedded WHERE len(vector) > 0",
    "failed_chunks": f"WITH {_EMBEDDED} SELECT id, file_path FROM embedded WHERE len(vector) = 0",
    "merge_retry": f"""WITH {_EMBEDDED}, m AS (SELECT id, CASE WHEN len(vector) = 0 AND doc_id % 2 = 0
        THEN [0.5, 0.5, 0.5, 0.5]::FLOAT[] ELSE vector END AS v FROM embedded)
      SELECT id, len(v)::INTEGER AS size, v[1] AS first FROM m""",
    "wrong_dimensions": f"WITH {_EMBEDDED} SELECT id, len(vector)::INTEGER AS size FROM embedded WHERE len(vector) <> {t.DIMENSIONS}",
    "batch_assignment": f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
      SELECT doc_id, position, position // {BATCH} AS batch, (position // {BATCH}) * {BATCH} AS start_index FROM n""",
    "progress": f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS c, count(*) OVER () AS n FROM documents),
      p AS (SELECT *, floor(c::DOUBLE / n * 100 + 0.5)::INTEGER AS percent FROM n)
      SELECT doc_id, percent, 10.0::DOUBLE + c::DOUBLE / n * 20 AS chunking, 30.0::DOUBLE + percent::DOUBLE / 100 * 50 AS embedding,
        (ceil(c / {BATCH}) * 2)::BIGINT AS seconds FROM p""",
    "insert_chunks": f"WITH {_EMBEDDED} SELECT {_COLS} FROM embedded WHERE len(vector) > 0",
    "delete_file": f"""WITH {t.SQL_SEARCH_CHUNKS} SELECT {_COLS} FROM chunks
      WHERE NOT regexp_matches(file_path, '/src(1|12)\\.(en|fr)$')""",
    "upsert_file": f"""WITH {t.SQL_SEARCH_CHUNKS}, x AS (SELECT *, regexp_matches(file_path, '7\\.[a-z]+$') AS changed FROM chunks)
      SELECT id, file_path, start_line, end_line, CASE WHEN changed THEN '// updated ' || id ELSE text END AS text, type,
        language, vector FROM x WHERE NOT (changed AND language = 'de')""",
    "latest_change_per_file": f"WITH {_LATEST} SELECT file_path, change_id, op FROM latest",
    "stream_upsert": f"""WITH {_LATEST} SELECT file_path || ':1-2' AS id, file_path, 1 AS start_line, 2 AS end_line,
      rtrim(text, chr(10)) AS text, 'export' AS type, {t.DIMENSIONS} AS dimensions FROM latest WHERE op = 'write'""",
}
