"""Index build: files to chunks to vectors to the store, with a report."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.config import Settings
from lumenseek.operators.reports import index_report
from lumenseek.plans.chunking import chunk_errors, chunk_files
from lumenseek.plans.isolation import isolated
from lumenseek.providers.embedding import EmbeddingProvider
from lumenseek.session import shared_folder
from lumenseek.sources import files as fs, listing
from lumenseek.sources.chunk_store import ChunkStore
from lumenseek.streaming.change_feed import embedded_rows

log = logging.getLogger("lumenseek.index")


@dataclass(frozen=True)
class IndexReport:
    success: bool
    total_files: int
    total_chunks: int
    successful_chunks: int
    failed_chunks: int
    duration_ms: int
    #: Why the whole run ended early; errors of files and chunks are in the error table.
    errors: list[str] = field(default_factory=list)
    error_count: int = 0
    error_table: str | None = None

    @property
    def success_rate(self) -> float:
        return 100 * self.successful_chunks / self.total_chunks if self.total_chunks else 0.0


@dataclass(frozen=True)
class Progress:
    phase: str
    percentage: float
    message: str


def run_errors(sources: DataFrame, embedded: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """What could not be indexed: files that cannot be chunked or whose chunking ``failed``, chunks that got no vector."""
    bad = chunk_errors(sources)
    if failed is not None:
        bad = bad.unionByName(failed)
    files = bad.select("file_path", F.lit("chunking").alias("stage"), F.concat(
        F.lit("Failed to chunk "), "file_path", F.lit(": "), "error").alias("error"))
    chunks = embedded.where("embed_error is not null").select("file_path", F.lit("embedding").alias("stage"), F.concat(
        F.lit("Failed to embed "), "id", F.lit(": "), "embed_error").alias("error"))
    return files.union(chunks)


def build_index(spark: SparkSession, files: DataFrame, store: ChunkStore, provider: EmbeddingProvider,
                settings: Settings = Settings(), *, append: bool = False,
                on_progress: Callable[[Progress], None] | None = None,
                chunker: Callable[[DataFrame], DataFrame] = chunk_files, **options) -> IndexReport:
    """Index ``files`` (of ``sources.files``) into the store.

    Chunks are written before they are embedded, by a stage that turns files
    it fails for into error rows; a text that a provider fails for is an error
    row of its own. Vectors are expensive, so they are computed once into a staging table of
    the shared folder, from which both the report and the index are made; a
    lost executor repeats its own tasks only. By default the new index takes
    the place of the old one; ``append=True`` adds to it, and running it twice
    then duplicates rows.
    """
    def tell(phase: str, message: str) -> None:
        log.info(message)
        if on_progress:
            on_progress(Progress(phase, float(sum(fv.PROGRESS_BANDS[phase])) if phase == "embedding"
                                 else float(fv.PROGRESS_BANDS[phase][0]), message))

    start = time.time()

    def finished(success: bool, errors: list[str], **counts) -> IndexReport:
        full = {"total_files": 0, "total_chunks": 0, "successful_chunks": 0, "failed_chunks": 0, **counts}
        return IndexReport(success, duration_ms=int((time.time() - start) * 1000), errors=errors, **full)

    tell("scanning", "Scanning files...")
    kept = fs.indexable(files, settings.max_file_size)
    total_files = kept.count()
    if total_files == 0:
        return finished(True, ["No files found to index"])
    store.check_dimension(provider.dimensions)

    tell("chunking", f"Chunking {total_files} files...")
    sources = fs.decoded(kept)
    chunks, failed = isolated(sources, chunker, "file_path")
    if listing.needs_reading(kept):
        failed = failed.unionByName(listing.unreadable(kept).withColumn("error", F.lit(fs.NO_ACCESS)))
    rows = embedded_rows(chunks, provider, batch_size=settings.batch_size, **options)
    staging = shared_folder(spark, "embedded")
    rows.write.parquet(staging)
    embedded = spark.read.parquet(staging)

    counts = index_report(embedded).first()
    error_table = store.write_errors(run_errors(sources, embedded, failed))
    errors = {"error_count": store.errors().count(), "error_table": error_table}
    if counts.chunks == 0:
        return finished(False, ["No code chunks extracted"], total_files=total_files, **errors)
    tell("embedding", f"Embedded {counts.successful_chunks} of {counts.chunks} chunks")

    tell("storing", "Storing chunks...")
    made_by = (provider.dimensions, provider.model.name, provider.name)
    found = embedded.drop("tokens_used", "embed_error")
    if append:
        store.insert(found)
        store.set_metadata(*made_by)
    else:
        store.replace_all(found, store.next_metadata(*made_by))
    # The staged vectors are in the index now.
    target = spark._jvm.org.apache.hadoop.fs.Path(staging)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    tell("complete", "Indexing complete")
    return finished(True, [], **errors, total_files=total_files, total_chunks=counts.chunks,
                    successful_chunks=counts.successful_chunks, failed_chunks=counts.failed_chunks)
