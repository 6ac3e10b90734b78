"""The engine a user talks to: index, search, update, report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek.config import Settings
from lumenseek.operators import grouping, ranking
from lumenseek.operators.reports import type_histogram, write_chunk_dump
from lumenseek.plans.chunking import chunk_files
from lumenseek.plans.indexing import IndexReport, build_index
from lumenseek.providers import health
from lumenseek.providers.embedding import EmbeddingProvider, create_provider
from lumenseek.providers.expansion import QueryExpander, create_expander
from lumenseek.providers.preparation import trim
from lumenseek.sources import files as fs, listing
from lumenseek.sources.chunk_store import ChunkStore, IndexStats
from lumenseek.streaming.change_feed import apply_changes


#: Most results of one search; what is collected and broadcast grows with it.
MAX_LIMIT = 100


@dataclass(frozen=True)
class SearchParams:
    query: str
    limit: int | None = None
    min_similarity: float | None = None
    chunk_types: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    hybrid: bool | None = None


@dataclass(frozen=True)
class SearchResultSet:
    """Results in re-ranked order; a failed search has an error and no rows."""

    query: str
    results: list = field(default_factory=list)
    total_results: int = 0
    search_time_ms: int = 0
    error: str | None = None


class CodeSearch:
    """Semantic search over a chunk table on Spark."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings = Settings(), *,
                 provider: EmbeddingProvider | None = None, expander: QueryExpander | None = None,
                 api_key: str | None = None, buckets: int | None = None):
        self.spark, self.settings = spark, settings
        self.store = ChunkStore(spark, path, buckets)
        self.provider = provider or create_provider(settings, api_key)
        self.expander = expander or create_expander(settings, api_key)

    # -- index ------------------------------------------------------------------------------
    def index_folder(self, root: str, **options) -> IndexReport:
        return self.index(self.folder_files(root), **options)

    def folder_files(self, root: str) -> DataFrame:
        """Files of a folder, listed by the tasks where they can open it, else by Spark's file source."""
        if listing.local_path(root) is None:
            return fs.list_files(self.spark, root, self.settings)
        return listing.scan_folder(self.spark, root, self.settings)

    def index_table(self, df: DataFrame, path: str, text: str, **options) -> IndexReport:
        return self.index(fs.files_from_table(df, path, text), **options)

    def index(self, files: DataFrame, **options) -> IndexReport:
        return build_index(self.spark, files, self.store, self.provider, self.settings, **options)

    def reindex_files(self, files: DataFrame) -> None:
        """Replace the chunks of ``files(file_path, text)``; a blank text just deletes."""
        self.store.check_dimension(self.provider.dimensions)
        apply_changes(files.select("file_path", F.lit("write").alias("op"), "text"), self.store, self.provider,
                      batch_size=self.settings.batch_size)

    def delete_files(self, paths: DataFrame) -> None:
        self.store.delete_files(paths)

    def clear(self) -> None:
        self.store.clear()

    def stats(self) -> IndexStats:
        return self.store.stats()

    def is_ready(self) -> bool:
        return self.store.is_ready()

    def chunk_count(self) -> int:
        return self.store.count() if self.store.exists() else 0

    def check_health(self) -> health.HealthStatus:
        return health.check_health(self.provider)

    def switch_model(self, settings: Settings, api_key: str | None = None) -> bool:
        """Use another model; its index starts empty. False if nothing changes."""
        provider = create_provider(settings, api_key)
        if (provider.name, provider.model.name) == (self.provider.name, self.provider.model.name):
            return False
        self.settings, self.provider = settings, provider
        self.store.clear()
        return True

    # -- chunk diagnosis ------------------------------------------------------------------------
    def chunk_report(self, files: DataFrame, dump_to: str | None = None) -> DataFrame:
        """Histogram of the chunk types of some files; optionally dumps the chunks as JSON."""
        chunks = chunk_files(fs.decoded(files))
        if dump_to:
            write_chunk_dump(chunks, dump_to)
        return type_histogram(chunks)

    # -- search ------------------------------------------------------------------------------------
    def search_frame(self, params: SearchParams) -> DataFrame:
        """The search as a DataFrame. Raises on a blank query.

        The ids of at most ``limit`` hits are collected first; the rest is lazy.
        """
        query = trim(params.query or "")
        if not query:
            raise ValueError("Search query cannot be empty")
        limit = self.settings.search_result_limit if params.limit is None else params.limit
        if not 1 <= limit <= MAX_LIMIT:
            raise ValueError(f"limit={limit} is outside [1, {MAX_LIMIT}]")
        floor = self.settings.min_similarity if params.min_similarity is None else params.min_similarity
        hybrid = self.settings.enable_hybrid_search if params.hybrid is None else params.hybrid
        text = self.expander.expand(query) if self.expander.enabled else query
        vector = self.provider.embed_query(self.provider.model.prepare(text, is_query=True))
        self.store.check_dimension(len(vector))
        chunks = self.store.read()
        # Rank on narrow columns first, then read the texts of the few hits.
        if hybrid:
            # The keyword side takes the words as typed, not as expanded.
            top = ranking.hybrid_search(chunks, vector, query, limit, floor, carry=["file_path"])
        else:
            top = ranking.vector_search(chunks.select("id", "file_path", "vector"), vector, limit, floor)
        hits = top.collect()
        found = ranking.attach_rows(hits, top.schema, self.store.rows_of(hits), repeats=not hybrid)
        found = ranking.filter_types(found, params.chunk_types)
        found = ranking.filter_extensions(found, params.extensions)
        return ranking.rerank(found, params.query)

    def search(self, params: SearchParams) -> SearchResultSet:
        """Search and collect at most ``limit`` rows; errors come back as data."""
        start = time.time()

        def elapsed() -> int:
            return int((time.time() - start) * 1000)

        try:
            if not trim(params.query or ""):
                raise ValueError("Search query cannot be empty")
            if not self.is_ready():
                raise RuntimeError("Index not initialized. Please index your workspace first.")
            rows = self.search_frame(params).orderBy("rerank_position").collect()
            return SearchResultSet(params.query, rows, len(rows), elapsed())
        except Exception as error:
            return SearchResultSet(params.query, search_time_ms=elapsed(), error=str(error))

    def search_by_file(self, params: SearchParams, root: str = "") -> DataFrame:
        return grouping.by_file(self.search_frame(params), root)

    def search_tree(self, params: SearchParams, root: str = "", types=None) -> DataFrame:
        return grouping.tree(self.search_frame(params), root, types)
