"""Search queries: vector, keyword, hybrid, re-rank, grouping."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.catalog import tables as t
from lumenseek.catalog.text import _LABEL, sql_trim
from lumenseek.config import Settings
from lumenseek.functions import scoring, vector as vec
from lumenseek.operators import grouping, ranking, reports
from lumenseek.operators.embedding import embed, retry_failed
from lumenseek.plans.chunking import fallback_chunks
from lumenseek.plans.engine import CodeSearch, SearchParams
from lumenseek.providers.embedding import HashProvider, HostedProvider
from lumenseek.providers.preparation import tokenize
from lumenseek.session import shared_folder, spread

LIMIT = 20
LOW_THRESHOLD = 0.1
WILDCARDS = ["the%and", "t_e ", "100%", "_", "src"]
KINDS = ["function", "class", "method", "interface", "jsx", "data", "component", "import"]

_SHOWN = ["rank", "id", "file_path", "type", "similarity", "distance", "score", "low_relevance"]


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.vector_search(t.search_chunks(spark, sf), t.query_vector(t.QUERY_TEXT), LIMIT, LOW_THRESHOLD)
    return found.select(*_SHOWN)


#: Vectors of whole documents that this process has written, by application and state of the table.
_written: dict[tuple, str] = {}


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``id`` and ``vector`` of all documents, embedded and written like an index, and again when the table changes."""
    files = t.table(spark, sf, "documents").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    state = files.distinct().agg(F.count(F.lit(1)), F.max("file_modification_time"), F.sum("file_size")).first()
    key = (spark.sparkContext.applicationId, sf, *state)
    if key not in _written:
        folder = shared_folder(spark, "hashed")
        _hashed(spark, sf).select("id", "vector").write.parquet(folder)
        _written[key] = folder
    return spark.read.schema("id string, vector array<float>").parquet(_written[key])


def vector_topk_default_threshold(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.vector_search(_vectors(spark, sf), t.query_vector("the and of to in is that"))
    return found.select("rank", "id", "similarity", "score", "low_relevance")


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with vectors of their whole text from the offline provider."""
    provider = HashProvider(t.DIMENSIONS)
    prepared = provider.model.prepared(F.col("text"), is_query=False)
    return embed(spread(t.document_chunks(spark, sf)), prepared, provider).drop("tokens_used", "embed_error")


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark, sf).select("doc_id", "vector")


class FlakyProvider(HashProvider):
    """Trouble that depends on a text's length alone, so that what comes of it can be said in SQL.

    Every 7th length raises; every 5th raises unless the text is sent alone; every 11th gets an empty vector. A
    recovered service only raises for odd multiples of 7.
    """

    def __init__(self, dimensions: int, recovered: bool = False):
        super().__init__(dimensions)
        self.recovered = recovered

    def embed(self, texts: list[str]) -> list[list[float]]:
        sizes = [len(text) for text in texts]
        if any(n % 7 == 0 and not (self.recovered and n % 2 == 0) for n in sizes):
            raise RuntimeError("hard text")
        if not self.recovered and len(texts) > 1 and any(n % 5 == 0 for n in sizes):
            raise RuntimeError("too much at once")
        return [[] if n % 11 == 0 and not self.recovered else v for n, v in zip(sizes, super().embed(texts))]


def embed_with_failures(spark: SparkSession, sf: str) -> DataFrame:
    """All documents embedded by a service in trouble, and what failed again after it recovered."""
    docs = t.texts(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    options = {"tries": 2, "sleep": lambda seconds: None}
    folder = shared_folder(spark, "flaky")
    embed(docs, F.col("text"), FlakyProvider(t.DIMENSIONS), **options).write.parquet(folder)
    first = spark.read.parquet(folder)
    done = retry_failed(first, F.col("text"), FlakyProvider(t.DIMENSIONS, recovered=True), key="doc_id", **options)
    return done.select("doc_id", F.col("embed_error").alias("first_error"), F.size("vector").alias("dimensions"))


def batch_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = t.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = {name: t.query_vector(text) for name, text in t.QUERY_TEXTS.items()}
    return ranking.many_nearest(vectors, queries, 5)


def keyword_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = ranking.keyword_matches(t.document_chunks(spark, sf), t.KEYWORD, 2 * LIMIT, order="doc_id")
    return found.select("keyword_rank", "doc_id", "id", "type")


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The hybrid search on ids, paths and vectors; the vector side reads no text."""
    return ranking.hybrid_search(t.search_chunks(spark, sf), t.query_vector(t.QUERY_TEXT), t.KEYWORD, LIMIT,
                                 LOW_THRESHOLD, carry=["file_path"])


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Full rows of the hybrid search: the at most ``LIMIT`` hits are fetched by their ids."""
    top = _ranked(spark, sf)
    hits = top.collect()
    ids = [int(h["id"].rsplit(":", 1)[1]) for h in hits]
    rows = t.document_chunks(spark, sf).where(F.col("doc_id").isin(ids)).drop("doc_id")
    return ranking.attach_rows(hits, top.schema, rows, repeats=False)


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf).select("rank", "id", "vector_rank", "keyword_rank", "rrf", "similarity", "score",
                                     "low_relevance")


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rerank(_hybrid(spark, sf), t.QUERY_TEXT).select(
        "rerank_position", "id", "similarity", "rerank_score")


def search_type_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.filter_types(_hybrid(spark, sf), KINDS).select("rank", "id", "type", "similarity")


def search_extension_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.filter_extensions(_hybrid(spark, sf), ["en", "fr"]).select("rank", "id", "language", "similarity")


def results_by_file(spark: SparkSession, sf: str) -> DataFrame:
    groups = grouping.by_file(ranking.rerank(_hybrid(spark, sf), t.QUERY_TEXT), "/ws")
    return groups.select(
        "file_path", "relative_path", "avg_score", F.size("chunks").cast("long").alias("n"),
        F.array_join(F.transform("chunks", lambda c: c["id"]), ",").alias("ids"),
        F.array_join(F.transform("chunks", lambda c: c["preview"]), "|").alias("previews"))


def results_tree(spark: SparkSession, sf: str) -> DataFrame:
    groups = grouping.tree(ranking.rerank(_hybrid(spark, sf), t.QUERY_TEXT), "/ws")
    return groups.select(
        "label", "description", "tooltip", "results",
        F.array_join(F.transform("chunks", lambda c: c["label"]), "|").alias("labels"),
        F.array_join(F.transform("chunks", lambda c: c["description"]), "|").alias("descriptions"),
        F.array_join(F.transform("chunks", lambda c: c["icon"]), "|").alias("icons"),
        F.array_join(F.transform("chunks", lambda c: c["tooltip"]), "|").alias("tooltips"))


def view_counts(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.view_counts(_hybrid(spark, sf), KINDS)


ENGINE_LINES, ENGINE_LIMIT = 20, 10
#: Of every 50 documents one is changed and one deleted between the two searches.
CHANGED, DELETED, EVERY = 7, 8, 50


def _engine_settings() -> Settings:
    return Settings(embedding_provider="hash", hash_dimensions=t.DIMENSIONS, max_file_size=1048576, min_similarity=0.0,
                    search_result_limit=ENGINE_LIMIT)


def engine_search(spark: SparkSession, sf: str) -> DataFrame:
    """All documents indexed, searched, some changed and deleted, and searched again, through the engine."""
    engine = CodeSearch(spark, shared_folder(spark, "engine"), _engine_settings(), buckets=8)
    path = F.concat(F.lit("/ws/doc_"), F.col("doc_id").cast("string"), F.lit(".css"))
    docs = t.table(spark, sf, "documents").select("doc_id", path.alias("file_path"), "text")
    engine.index_table(docs, "file_path", "text", chunker=lambda files: fallback_chunks(files, ENGINE_LINES))

    def shown(phase: str) -> list:
        rows = engine.search_frame(SearchParams(t.QUERY_TEXT)).select(
            F.lit(phase).alias("phase"), "rerank_position", "id", "type", "similarity", "rerank_score")
        return rows.collect()  # at most the limit

    before = shown("built")
    part = F.pmod("doc_id", F.lit(EVERY))
    engine.reindex_files(docs.where(part == CHANGED).select("file_path", F.concat(
        F.lit(f"{t.QUERY_TEXT} "), F.col("doc_id").cast("string")).alias("text")))
    engine.delete_files(docs.where(part == DELETED).select("file_path"))
    return spark.createDataFrame(before + shown("changed"), "phase string, rerank_position int, id string, type string, "
                                 "similarity double, rerank_score double")


def keyword_wildcards(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords with LIKE wildcards, each by itself."""
    found = [ranking.keyword_matches(t.document_chunks(spark, sf), keyword, LIMIT, order="doc_id").select(
        F.lit(keyword).alias("keyword"), "keyword_rank", "doc_id") for keyword in WILDCARDS]
    return functools.reduce(DataFrame.union, found)


def hybrid_with_quote(spark: SparkSession, sf: str) -> DataFrame:
    """A keyword with a quote leaves the vector search alone."""
    found = ranking.hybrid_search(t.search_chunks(spark, sf), t.query_vector(t.QUERY_TEXT), "it's", LIMIT, LOW_THRESHOLD)
    return found.select("rank", "id", "similarity", "score", "low_relevance")


class ScriptedService:
    """A hosted service that answers in reversed order and charges a token for every four characters begun.

    It answers inside the task and has no limit of requests a minute.
    """

    def call(self, path: str, body: dict | None = None, **_) -> dict:
        texts = body["input"]
        data = [{"index": i, "embedding": [len(text), text.count("a")]} for i, text in enumerate(texts)]
        return {"data": data[::-1], "usage": {"total_tokens": sum(-(-len(text) // 4) for text in texts)}}


def _hosted(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.texts(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return embed(docs, F.col("text"), HostedProvider("text-embedding-3-small", "key", transport=ScriptedService(), per_minute=None))


def hosted_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a hosted service, put in order by the index of each answer."""
    return _hosted(spark, sf).select("doc_id", F.get("vector", F.lit(0)).alias("n_chars"), F.get("vector", F.lit(1)).alias("letters"))


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    return reports.token_usage(_hosted(spark, sf))


def display_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity, percent and relevance flag of every stored vector to one query."""
    d2 = vec.squared_l2(F.col("embedding"), t.query_vector(t.QUERY_TEXT))
    sim = vec.similarity(F.col("d2"))
    return t.table(spark, sf, "embeddings").withColumn("d2", d2).select(
        "vec_id", "d2", sim.alias("similarity"), scoring.display_score(sim).alias("score"),
        scoring.low_relevance(sim).alias("low_relevance"))


def rerank_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The four re-rank signals of every chunk."""
    q = tokenize(t.QUERY_TEXT.lower())
    return spread(t.document_chunks(spark, sf)).select(
        "doc_id", scoring.token_match_ratio(q, F.col("text")).alias("ratio"),
        scoring.path_match(q, F.col("file_path")).alias("path"),
        scoring.type_bonus(F.col("type")).alias("bonus"))


def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Norm and unit form of every vector, scaled by its label so that lengths differ."""
    scaled = F.transform("embedding", lambda x: x * F.col("label").cast("float"))
    return t.table(spark, sf, "embeddings").withColumn("scaled", scaled).select(
        "vec_id", vec.l2_norm(F.col("scaled")).alias("norm"),
        vec.l2_normalize(F.col("scaled")).alias("unit"))


QUERIES = {f.__name__: f for f in (
    vector_topk, vector_topk_default_threshold, hash_embed, embed_with_failures, engine_search, keyword_wildcards, hybrid_with_quote, hosted_vectors,
    token_usage, batch_vector_topk, keyword_scan, hybrid_rrf,
    rerank, search_type_filtered, search_extension_filtered, results_by_file, results_tree, view_counts,
    display_scores, rerank_signals, l2_normalize)}

# -- SQL ---------------------------------------------------------------------------------

_Q = t.sql_list(t.query_vector(t.QUERY_TEXT))
_SCORED = f"scored AS (SELECT *, {t.sql_d2('vector', _Q)} AS d2 FROM chunks)"
_WITH = f"WITH {t.SQL_SEARCH_CHUNKS}, {_SCORED}"
_SCORE = "floor(similarity * 100 + 0.5)::INTEGER AS score, similarity < 0.4 AS low_relevance"
_WS = fv.WS.replace("'", "''")

_HYBRID = f"""{_WITH},
v AS (SELECT *, row_number() OVER (ORDER BY d2, id)::INTEGER AS vr FROM scored ORDER BY d2, id LIMIT {2 * LIMIT}),
k AS (SELECT id, row_number() OVER (ORDER BY id)::INTEGER AS kr FROM chunks
      WHERE text LIKE '%{t.KEYWORD}%' ORDER BY id LIMIT {2 * LIMIT}),
fused AS (
  SELECT coalesce(v.id, k.id) AS id, vr, kr, d2,
         coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce(1.0::DOUBLE / (60 + kr), 0) AS rrf
  FROM v FULL JOIN k ON v.id = k.id),
kept AS (SELECT *, {t.SQL_SIMILARITY} AS similarity FROM fused),
cut AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, vr NULLS LAST, kr)::INTEGER AS rank FROM kept
        WHERE similarity >= {LOW_THRESHOLD}),
hybrid AS (
  SELECT cut.*, c.file_path, c.type, c.language, c.text, c.start_line, c.end_line, {_SCORE}
  FROM cut JOIN chunks c ON c.id = cut.id WHERE rank <= {LIMIT})"""


def _sql_tokens(text: str) -> str:
    spread = f"regexp_replace(lower({text}), '([a-z])([A-Z])', '\\1 \\2', 'g')"
    spread = f"regexp_replace({spread}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    spread = f"lower(regexp_replace({spread}, '[_\\-./\\\\]', ' ', 'g'))"
    return f"list_filter(string_split_regex({spread}, '{_WS}+'), lambda x: length(x) > 1)"


_BONUS = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fv.TYPE_BONUS.items()) + " ELSE 0.5::DOUBLE END"


def _sql_signals(source: str) -> str:
    query = t.QUERY_TEXT.replace("'", "''")
    q = _sql_tokens(f"'{query}'")
    return f"""tokens AS (
  SELECT *, {q} AS q, {_sql_tokens('text')} AS ct, {_sql_tokens('file_path')} AS pt FROM {source}),
signals AS (
  SELECT *,
    len(list_filter(q, lambda a: len(list_filter(ct, lambda c: contains(c, a) OR contains(a, c))) > 0))::DOUBLE
      / greatest(len(q), 1) AS ratio,
    CASE WHEN len(list_filter(q, lambda a: len(list_filter(pt, lambda p: contains(p, a))) > 0)) > 0
      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS path,
    {_BONUS} AS bonus
  FROM tokens)"""


_RERANKED = f"""{_HYBRID}, {_sql_signals('hybrid')},
reranked AS (
  SELECT *, 0.5::DOUBLE * similarity + 0.3::DOUBLE * ratio + 0.1::DOUBLE * path + 0.1::DOUBLE * bonus AS rerank_score
  FROM signals),
ordered AS (SELECT *, row_number() OVER (ORDER BY rerank_score DESC, rank)::INTEGER AS rerank_position FROM reranked)"""

_KIND_LIST = ", ".join(f"'{k}'" for k in KINDS)


def _sql_preview(width: int) -> str:
    return f"substr(regexp_replace(regexp_replace(text, '{_WS}+', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), 1, {width})"


_ICON = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.TYPE_ICONS.items()) + f" ELSE '{fv.DEFAULT_ICON}' END"
_ONE_DECIMAL = ("((floor(similarity * 100 * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || "
                "(floor(similarity * 100 * 10 + 0.5)::BIGINT % 10)::VARCHAR)")


def sql_hashed(text: str, source: str, key: str, prefix: str = "", hyphens: bool = True) -> str:
    """Hash vectors of a text column, as CTE ``hashed(key, vector)``."""
    split = f"regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    split = f"regexp_replace({split}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    split = f"replace({split}, '_', ' ')"
    if hyphens:
        split = f"replace({split}, '-', ' ')"
    split = f"regexp_replace({split}, '{_WS}+', ' ', 'g')"
    return f"""words AS (
  SELECT {key}, unnest(string_split(lower('{prefix}' || trim({split}, ' ')), ' ')) AS w FROM {source}),
slots AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::UBIGINT % {t.DIMENSIONS} AS slot,
         sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS s
  FROM words WHERE w <> '' GROUP BY ALL),
norms AS (SELECT {key}, sqrt(sum(s * s)) AS n FROM slots GROUP BY {key}),
grid AS (SELECT {key}, unnest(range({t.DIMENSIONS})) AS slot FROM {source}),
hashed AS (
  SELECT g.{key}, list((CASE WHEN n IS NULL OR n = 0 THEN 0 ELSE coalesce(s, 0) / n END)::FLOAT ORDER BY g.slot) AS vector
  FROM grid g LEFT JOIN slots USING ({key}, slot) LEFT JOIN norms USING ({key}) GROUP BY g.{key})"""


_DEFAULT_Q = t.sql_list(t.query_vector("the and of to in is that"))
_BATCH = " UNION ALL ".join(
    f"SELECT '{name}' AS query, vec_id AS id, {t.sql_d2('embedding', t.sql_list(t.query_vector(text)))} AS d2 FROM embeddings"
    for name, text in t.QUERY_TEXTS.items())

_ENGINE_Q = t.sql_list(t.query_vector(HashProvider(t.DIMENSIONS).model.prepare(t.QUERY_TEXT, is_query=True)))
_ENGINE = f"""WITH docs AS (SELECT doc_id, '/ws/doc_' || doc_id || '.css' AS file_path, text FROM documents),
doc_lines AS (SELECT doc_id, file_path, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line
      FROM docs),
pieces AS (SELECT doc_id, file_path, min(i) + 1 AS s, max(i) + 1 AS e, string_agg(line, chr(10) ORDER BY i) AS code
           FROM doc_lines GROUP BY doc_id, file_path, i // {ENGINE_LINES}),
built AS (SELECT doc_id, file_path, file_path || ':' || s || '-' || e AS id, 'block' AS type, {sql_trim('code')} AS text FROM pieces
          WHERE {sql_trim('code')} <> ''),
chunks AS (
  SELECT 'built' AS phase, * FROM built
  UNION ALL SELECT 'changed', * FROM built WHERE doc_id % {EVERY} NOT IN ({CHANGED}, {DELETED})
  UNION ALL SELECT 'changed', doc_id, file_path, file_path || ':1-1', 'css', '{t.QUERY_TEXT} ' || doc_id FROM docs
            WHERE doc_id % {EVERY} = {CHANGED}),
inputs AS (SELECT phase || id AS k, *, concat_ws(chr(10), '[CSS]', 'doc_' || doc_id || '.css', {_LABEL}, '', text) AS input FROM chunks),
{sql_hashed('input', 'inputs', 'k', 'search_document: ', hyphens=False)},
scored AS (SELECT i.*, {t.sql_d2('vector', _ENGINE_Q)} AS d2 FROM hashed JOIN inputs i USING (k)),
hits AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY d2, id)::INTEGER AS rank, {t.SQL_SIMILARITY} AS similarity
         FROM scored QUALIFY rank <= {ENGINE_LIMIT}),
{_sql_signals('hits')},
reranked AS (SELECT *, 0.5::DOUBLE * similarity + 0.3::DOUBLE * ratio + 0.1::DOUBLE * path + 0.1::DOUBLE * bonus AS rerank_score FROM signals)
SELECT phase, row_number() OVER (PARTITION BY phase ORDER BY rerank_score DESC, rank)::INTEGER AS rerank_position, id, type,
       similarity, rerank_score FROM reranked"""
_WILD = " UNION ALL ".join(f"""(SELECT '{w}' AS keyword, row_number() OVER (ORDER BY doc_id)::INTEGER AS keyword_rank, doc_id FROM documents
      WHERE text LIKE '%{w}%' ORDER BY doc_id LIMIT {LIMIT})""" for w in WILDCARDS)

ORACLES = {
    "engine_search": _ENGINE,
    "keyword_wildcards": _WILD,
    "hybrid_with_quote": f"""{_WITH},
      top AS (SELECT *, row_number() OVER (ORDER BY d2, id)::INTEGER AS rank, {t.SQL_SIMILARITY} AS similarity FROM scored)
      SELECT rank, id, similarity, {_SCORE} FROM top WHERE rank <= {LIMIT} AND similarity >= {LOW_THRESHOLD}""",
    "hosted_vectors": """SELECT doc_id, length(coalesce(text, ''))::FLOAT AS n_chars,
      (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::FLOAT AS letters FROM documents""",
    "token_usage": """SELECT coalesce(sum(ceil(length(coalesce(text, '')) / 4.0)), 0)::BIGINT AS tokens_used FROM documents""",
    "vector_topk": f"""{_WITH},
      top AS (SELECT *, row_number() OVER (ORDER BY d2, id)::INTEGER AS rank, {t.SQL_SIMILARITY} AS similarity FROM scored)
      SELECT rank, id, file_path, type, similarity, sqrt(d2) AS distance, {_SCORE} FROM top
      WHERE rank <= {LIMIT} AND similarity >= {LOW_THRESHOLD}""",
    "vector_topk_default_threshold": f"""WITH {t.SQL_DOCUMENT_CHUNKS}, {sql_hashed('text', 'documents', 'doc_id')},
      scored AS (SELECT id, {t.sql_d2('vector', _DEFAULT_Q)} AS d2 FROM hashed JOIN document_chunks USING (doc_id)),
      top AS (SELECT *, row_number() OVER (ORDER BY d2, id)::INTEGER AS rank, {t.SQL_SIMILARITY} AS similarity FROM scored)
      SELECT rank, id, similarity, {_SCORE} FROM top WHERE rank <= 20 AND similarity >= 0.5""",
    "embed_with_failures": f"""SELECT doc_id, CASE WHEN n % 7 = 0 THEN 'hard text' WHEN n % 11 = 0 THEN 'empty vector' END AS first_error,
      CASE WHEN n % 7 = 0 AND n % 2 = 1 THEN 0 ELSE {t.DIMENSIONS} END AS dimensions
      FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents)""",
    "hash_embed": f"WITH {sql_hashed('text', 'documents', 'doc_id')} SELECT doc_id, vector FROM hashed",
    "batch_vector_topk": f"""SELECT query, id, d2, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, id)::INTEGER AS rank FROM ({_BATCH})) WHERE rank <= 5""",
    "keyword_scan": f"""WITH {t.SQL_DOCUMENT_CHUNKS}
      SELECT row_number() OVER (ORDER BY doc_id)::INTEGER AS keyword_rank, doc_id, id, type FROM document_chunks
      WHERE text LIKE '%{t.KEYWORD}%' ORDER BY doc_id LIMIT {2 * LIMIT}""",
    "hybrid_rrf": f"""{_HYBRID} SELECT rank, id, vr AS vector_rank, kr AS keyword_rank, rrf, similarity, score,
      low_relevance FROM hybrid""",
    "rerank": f"{_RERANKED} SELECT rerank_position, id, similarity, rerank_score FROM ordered",
    "search_type_filtered": f"{_HYBRID} SELECT rank, id, type, similarity FROM hybrid WHERE type IN ({_KIND_LIST})",
    "search_extension_filtered": f"""{_HYBRID} SELECT rank, id, language, similarity FROM hybrid
      WHERE language IN ('en', 'fr')""",
    "results_by_file": f"""{_RERANKED}
      SELECT file_path, substr(file_path, 5) AS relative_path, avg(score) AS avg_score, count(*) AS n,
             string_agg(id, ',' ORDER BY score DESC, rerank_position) AS ids,
             string_agg({_sql_preview(100)}, '|' ORDER BY score DESC, rerank_position) AS previews
      FROM ordered GROUP BY file_path""",
    "results_tree": f"""{_RERANKED}
      SELECT substr(file_path, 5) AS label, floor(avg(score) + 0.5)::BIGINT || '%' AS description,
             file_path || chr(10) || count(*) || ' result' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS tooltip,
             count(*) AS results,
             string_agg({_sql_preview(60)} || CASE WHEN length(text) > 60 THEN '...' ELSE '' END, '|'
                        ORDER BY similarity DESC, rerank_position) AS labels,
             string_agg('Lines ' || start_line || '-' || end_line, '|' ORDER BY similarity DESC, rerank_position) AS descriptions,
             string_agg({_ICON}, '|' ORDER BY similarity DESC, rerank_position) AS icons,
             string_agg('Score: ' || score || '% (similarity: ' || {_ONE_DECIMAL} || '%)' || chr(10) ||
               CASE WHEN low_relevance THEN 'Low Relevance - May not be relevant to your query' || chr(10) ELSE '' END ||
               'Type: ' || type || chr(10) || 'Lines: ' || start_line || '-' || end_line, '|'
               ORDER BY similarity DESC, rerank_position) AS tooltips
      FROM ordered GROUP BY file_path""",
    "view_counts": f"""{_HYBRID} SELECT count(*) AS result_count, count(DISTINCT file_path) AS file_count FROM hybrid
      WHERE type IN ({_KIND_LIST})""",
    "display_scores": f"""WITH s AS (SELECT vec_id, {t.sql_d2('embedding', _Q)} AS d2 FROM embeddings),
      m AS (SELECT *, {t.SQL_SIMILARITY} AS similarity FROM s) SELECT vec_id, d2, similarity, {_SCORE} FROM m""",
    "rerank_signals": f"""WITH {t.SQL_DOCUMENT_CHUNKS}, {_sql_signals('document_chunks')}
      SELECT doc_id, ratio, path, bonus FROM signals""",
    "l2_normalize": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x * label::FLOAT) AS v FROM embeddings),
      n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM s)
      SELECT vec_id, norm, CASE WHEN norm = 0 THEN list_transform(v, lambda x: x::DOUBLE)
        ELSE list_transform(v, lambda x: x::DOUBLE / norm) END AS unit FROM n""",
}
