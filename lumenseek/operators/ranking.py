"""Ranked retrieval: vector top-k, keyword scan, rank fusion, re-rank.

Every operator reduces the table to at most ``2 * limit`` rows with
TakeOrderedAndProject before anything is ranked by position, so the
unpartitioned windows below only ever see that bounded list.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenseek import fixed_values as fv
from lumenseek.functions import scoring, vector as vec
from lumenseek.providers import preparation
from lumenseek.session import ship_package


def _ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """1-based position in an already limited list."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order)))


def nearest(chunks: DataFrame, query: Sequence[float], count: int) -> DataFrame:
    """The ``count`` nearest rows with d2 and rank; ties go to the smaller id."""
    scored = chunks.where(vec.has_vector(F.col("vector"))).withColumn(
        "d2", vec.squared_l2(F.col("vector"), query)).drop("vector")
    return _ranked(scored.orderBy("d2", "id").limit(count), "vector_rank", "d2", "id")


def keyword_matches(chunks: DataFrame, keyword: str, count: int, *, order: str = "id",
                    wildcards: bool = True) -> DataFrame:
    """The first ``count`` rows, in ``order``, whose text holds the keyword.

    Matching is case sensitive and ranks nothing. With ``wildcards`` the
    keyword's ``%`` and ``_`` act as LIKE wildcards.
    """
    text = F.col("text")
    pattern = keyword.replace("\\", "\\\\")
    hit = text.like(f"%{pattern}%") if wildcards else F.contains(text, F.lit(keyword))
    found = chunks.where(hit).orderBy(order).limit(count)
    return _ranked(found, "keyword_rank", order)


def with_similarity(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", vec.similarity(F.col("d2"))).withColumn(
        "distance", F.sqrt(F.col("d2")))


def with_display(df: DataFrame) -> DataFrame:
    sim = F.col("similarity")
    return df.withColumn("score", scoring.display_score(sim)).withColumn(
        "low_relevance", scoring.low_relevance(sim))


def vector_search(chunks: DataFrame, query: Sequence[float], limit: int = 20,
                  min_similarity: float = 0.5) -> DataFrame:
    """Top ``limit`` rows by similarity, threshold inclusive, with ``rank``.

    The threshold keeps a prefix of a list sorted by distance, so fetching
    exactly ``limit`` rows gives what over-fetching and cutting gives.
    """
    top = with_similarity(nearest(chunks, query, limit))
    top = top.where(F.col("similarity") >= min_similarity)
    return with_display(top.withColumnRenamed("vector_rank", "rank"))


def attach_rows(hits: list, schema: T.StructType, rows: DataFrame, *, repeats: bool) -> DataFrame:
    """Full rows of a collected result list with ``id`` and ``rank``.

    The list has at most ``limit`` entries, which bounds what is broadcast.
    Where an index holds an id more than once, ``repeats`` decides whether
    every stored row shows up, at consecutive ranks, or one of them: the first
    by its place in the file, then by time.
    """
    first: dict = {}
    for hit in sorted(hits, key=lambda h: h["rank"]):
        first.setdefault(hit["id"], hit)
    top = rows.sparkSession.createDataFrame(list(first.values()), schema).drop("file_path")
    joined = rows.drop("vector").join(F.broadcast(top), "id")
    if not repeats:
        place = [c for c in ("chunk_index_in_file", "timestamp") if c in joined.columns]
        one = F.row_number().over(W.partitionBy("id").orderBy(*place, F.xxhash64("text")))
        return joined.withColumn("_one", one).where("_one = 1").drop("_one")
    order = [F.asc("_rank"), F.asc("id"), F.asc("chunk_index_in_file")]
    joined = joined.withColumnRenamed("rank", "_rank").orderBy(*order).limit(len(hits))
    return _ranked(joined, "rank", *order).drop("_rank")


def fuse_ranks(vector_list: DataFrame, keyword_list: DataFrame, k: int = fv.RRF_K) -> DataFrame:
    """Reciprocal rank fusion: a full outer join of two bounded lists on id.

    When an id occurs twice in a list its last rank counts, while its place
    among equal scores stays that of its first occurrence. Rows found by
    keyword only have no distance and therefore similarity 1.
    """
    def per_id(df: DataFrame, rank: str, keep: list[str]) -> DataFrame:
        return df.groupBy("id").agg(
            F.max(rank).alias(rank), F.min(rank).alias(f"{rank}_first"),
            *[F.max_by(c, rank).alias(c) for c in keep])

    shared = [c for c in keyword_list.columns if c not in ("id", "keyword_rank", "vector", "d2")]
    v = per_id(vector_list, "vector_rank", [*shared, "d2"])
    # The keyword list shows a repeated id with its first row.
    kw = keyword_list.groupBy("id").agg(
        F.max("keyword_rank").alias("keyword_rank"), F.min("keyword_rank").alias("keyword_rank_first"),
        *[F.min_by(c, "keyword_rank").alias(f"k_{c}") for c in shared])
    both = v.join(kw, "id", "full_outer")
    score = (F.coalesce(1 / (k + F.col("vector_rank")), F.lit(0.0))
             + F.coalesce(1 / (k + F.col("keyword_rank")), F.lit(0.0)))
    from_vector = F.col("vector_rank").isNotNull()
    cols = [F.when(from_vector, F.col(c)).otherwise(F.col(f"k_{c}")).alias(c) for c in shared]
    return both.select(
        "id", *cols, "d2", "vector_rank", "keyword_rank", score.alias("rrf"),
        "vector_rank_first", "keyword_rank_first")


def hybrid_search(chunks: DataFrame, query: Sequence[float], keyword: str, limit: int = 20,
                  min_similarity: float = 0.5, *, order: str = "id",
                  carry: Sequence[str] | None = None) -> DataFrame:
    """Vector and keyword lists, fused, thresholded and cut, with ``rank``.

    ``carry`` names the columns to keep beside the ranks (all by default).
    Without the text among them, the vector side does not read texts.

    A keyword holding a quote could not be matched by the tool being
    replaced, which then ran the vector search alone; so does this.
    """
    carry = [c for c in carry or chunks.columns if c not in ("id", "vector")]
    by_vector = chunks.select("id", *carry, "vector")
    if "'" in keyword:
        return vector_search(by_vector, query, limit, min_similarity)
    count = limit * fv.OVER_FETCH
    by_word = chunks.select(*dict.fromkeys(["id", *carry, "text", order]))
    words = keyword_matches(by_word, keyword, count, order=order).select("id", *carry, "keyword_rank")
    fused = fuse_ranks(nearest(by_vector, query, count), words)
    kept = with_similarity(fused).where(F.col("similarity") >= min_similarity)
    by = [F.desc("rrf"), F.asc_nulls_last("vector_rank_first"), F.asc("keyword_rank_first")]
    ranked = _ranked(kept.orderBy(*by).limit(limit), "rank", *by)
    return with_display(ranked.drop("vector_rank_first", "keyword_rank_first"))


def filter_types(results: DataFrame, chunk_types: Sequence[str] | None) -> DataFrame:
    """Keep the given chunk types; none given keeps all. Runs after the cut."""
    return results.where(F.col("type").isin(*chunk_types)) if chunk_types else results


def filter_extensions(results: DataFrame, extensions: Sequence[str] | None) -> DataFrame:
    return results.where(F.col("language").isin(*extensions)) if extensions else results


def rerank(results: DataFrame, query: str) -> DataFrame:
    """Reorder (never drop) results by the composite of four signals.

    ``rank`` breaks ties, which keeps the sort stable; the new order is in
    ``rerank_position``.
    """
    tokens = preparation.tokenize(query.lower())
    scored = results.withColumn("rerank_score", scoring.rerank_score(
        F.col("similarity"), scoring.token_match_ratio(tokens, F.col("text")),
        scoring.path_match(tokens, F.col("file_path")), scoring.type_bonus(F.col("type"))))
    return _ranked(scored, "rerank_position", F.desc("rerank_score"), F.asc("rank"))


def many_nearest(vectors: DataFrame, queries: dict[str, Sequence[float]], count: int,
                 *, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The ``count`` nearest rows for each of a fixed set of query vectors.

    One pass over the table: each task scores its Arrow batches and keeps
    its own ``count`` best per query, so only tasks x queries x count small
    rows are shuffled, keyed by query. No pair list is ever built.
    """
    ship_package(vectors.sparkSession)
    names = sorted(queries)
    matrix = np.asarray([queries[n] for n in names], dtype=np.float64)
    id_type = vectors.schema[id_col].dataType
    batch_id_type = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("id", id_type),
                           T.StructField("d2", T.DoubleType())])

    def local_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, object]]] = [[] for _ in names]
        for batch in batches:
            ids = batch.column(0)
            for i, q in enumerate(matrix):
                d2 = vec.array_distances(batch.column(1), q)
                known = np.flatnonzero(~np.isnan(d2))
                if len(known) > count:
                    # Everything up to the count-th distance, ties included.
                    bound = np.partition(d2[known], count - 1)[count - 1]
                    known = known[d2[known] <= bound]
                merged = best[i] + [(float(d2[j]), ids[j].as_py()) for j in known.tolist()]
                best[i] = sorted(merged)[:count]
        rows = [(names[i], rid, d2) for i in range(len(names)) for d2, rid in best[i]]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], batch_id_type),
                 pa.array([r[2] for r in rows], pa.float64())], names=["query", "id", "d2"])

    partial = vectors.select(id_col, vector_col).mapInArrow(local_best, schema)
    w = W.partitionBy("query").orderBy("d2", "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
