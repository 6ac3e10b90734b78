"""File changes as a stream: latest change per path, applied to the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from lumenseek.operators.embedding import embed
from lumenseek.plans.chunking import chunk_files
from lumenseek.providers.embedding import EmbeddingProvider
from lumenseek.providers.models import index_prepared
from lumenseek.functions import text as tx
from lumenseek.functions.paths import extension
from lumenseek.sources.chunk_store import BucketedTable, ChunkStore

DELETE = "delete"


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last change of every path, by time and then by change number.

    A maximum of structs combines inside the map tasks, so a path with a
    large share of all changes costs no more than any other; a window would
    sort all its rows in one task.
    """
    rest = [c for c in changes.columns if c not in ("file_path", "ts", "change_id")]
    last = F.max(F.struct("ts", "change_id", *rest)).alias("last")
    return changes.groupBy("file_path").agg(last).select("file_path", "last.*")


def embedded_rows(chunks: DataFrame, provider: EmbeddingProvider, **options) -> DataFrame:
    """Embed chunks the way the index path does."""
    prepared = index_prepared(tx.embedding_input(
        F.col("language"), F.col("file_path"), F.col("type"), F.col("text")))
    return embed(chunks, prepared, provider, **options)


def apply_changes(batch: DataFrame, store: ChunkStore, provider: EmbeddingProvider, **options) -> None:
    """Upsert one batch of latest changes; deleted and emptied files lose their rows.

    Applying a batch twice changes nothing, so a batch repeated after a
    failure is harmless.
    """
    language: Column = F.lower(extension(F.col("file_path")))
    written = batch.where(F.col("op") != DELETE).select("file_path", language.alias("language"), "text")
    rows = embedded_rows(chunk_files(written), provider, **options).drop("tokens_used", "embed_error")
    store.upsert(batch.select("file_path"), rows)


def _with_texts(batch: DataFrame, load_text: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch with texts; a path whose text cannot be found any more is deleted."""
    texts = load_text(batch.where(F.col("op") != DELETE)).select("file_path", "text")
    full = batch.select("file_path", "op").join(texts, "file_path", "left")
    return full.withColumn("op", F.when(F.col("text").isNull(), DELETE).otherwise(F.col("op")))


def applied_changes(store: ChunkStore, changes: DataFrame) -> BucketedTable:
    """The table beside the store that has the time and number of the last change applied to each path.

    Deleted files keep theirs, so that a late change does not bring them back.
    """
    kinds = {f.name: f.dataType for f in changes.schema.fields}
    schema = T.StructType([T.StructField(name, kinds[name]) for name in ("file_path", "ts", "change_id")])
    applied = BucketedTable(store.spark, f"{store.path}/_applied", schema)
    # A rebuild may give the store other buckets; this table keeps its own.
    applied.wanted = store.buckets
    return applied


def not_late(batch: DataFrame, applied: BucketedTable) -> DataFrame:
    """The changes that are no older than what was applied to their path.

    An equal one passes: it belongs to a batch that is repeated.
    """
    known = applied.rows_for(batch).select("file_path", F.struct("ts", "change_id").alias("_applied"))
    joined = batch.join(known, "file_path", "left")
    return joined.where(F.col("_applied").isNull() | (F.struct("ts", "change_id") >= F.col("_applied"))).drop("_applied")


def start_change_feed(changes: DataFrame, store: ChunkStore, provider: EmbeddingProvider, checkpoint: str, *,
                      available_now: bool = False, debounce: str = "1 second",
                      load_text: Callable[[DataFrame], DataFrame] | None = None,
                      on_batch: Callable[[int], None] | None = None, **options) -> StreamingQuery:
    """Keep the store in step with a stream of (file_path, ts, change_id, op).

    The stream itself has no state. Changes of a batch are reduced to the
    last one per path; what was applied to a path is kept in a table beside the
    store, of which a batch reads and rewrites the buckets that it touches.
    Late changes are rejected by it. ``load_text`` turns a batch of changes
    into (file_path, text) of the files to index; a feed that carries a
    ``text`` column itself needs none.

    The trigger interval is the debounce: changes of one interval are applied
    together and only the last one per path counts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        # Used several times below: written once.
        with store.staged(not_late(latest_changes(batch), applied), f"feed-{batch_id}") as changed:
            apply_changes(_with_texts(changed, load_text) if load_text else changed, store, provider, **options)
            # After the rows: a batch that dies in between is applied again.
            applied.upsert(changed, changed)
        if on_batch:
            on_batch(batch_id)

    applied = applied_changes(store, changes)
    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=debounce)
    return writer.start()
