"""Text function queries over pages, documents, events and derived source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.catalog import tables as t
from lumenseek.functions import scoring, text as tx
from lumenseek.providers.models import embedding_model, index_prepared

MODEL = embedding_model("ollama", "nomic-embed-text")


def split_identifiers_query(spark: SparkSession, sf: str) -> DataFrame:
    """Query-side preparation of whole pages, with and without the task prefix."""
    return t.texts(spark, sf, "pages").select(
        "page_id", MODEL.prepared(F.col("url"), is_query=True).alias("url_query"),
        MODEL.prepared(F.col("html")).alias("html_plain"))


def split_identifiers_index(spark: SparkSession, sf: str) -> DataFrame:
    return t.texts(spark, sf, "pages").select(
        "page_id", index_prepared(F.col("url")).alias("url_document"),
        tx.split_identifiers(F.col("html"), hyphens=False).alias("html_split"))


def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return t.texts(spark, sf, "pages").select(
        "page_id", tx.tokenize(F.col("url")).alias("url_tokens"), tx.tokenize(F.col("html")).alias("html_tokens"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return t.texts(spark, sf, "documents").select(
        "doc_id", tx.utf16_length(text).alias("units"), tx.token_estimate(text).alias("estimate"),
        tx.token_estimate_simple(text).alias("simple"))


def _code_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the derived source files with the chunk type they are taken for."""
    from lumenseek.operators.cutting import explode_lines

    lines = explode_lines(t.source_files(spark, sf))
    return lines.withColumn("type", t.chunk_type_of(F.col("doc_id") + F.col("line_no")))


def identifier_name(spark: SparkSession, sf: str) -> DataFrame:
    return _code_lines(spark, sf).select(
        "doc_id", "line_no", "type", tx.identifier_name(F.col("line"), F.col("type")).alias("name"))


def embedding_input(spark: SparkSession, sf: str) -> DataFrame:
    files = t.source_files(spark, sf).withColumn("type", t.chunk_type_of(F.col("doc_id")))
    return files.select("doc_id", tx.embedding_input(
        F.col("language"), F.col("file_path"), F.col("type"), F.col("text")).alias("input"))


def type_names(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("type")
    return t.document_chunks(spark, sf).select(
        "doc_id", tx.type_label(kind).alias("label"), tx.type_plural(kind).alias("plural"),
        tx.type_icon(kind).alias("icon"), scoring.type_bonus(kind).alias("bonus"))


def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    return t.texts(spark, sf, "pages").select("page_id", tx.html_escape(F.col("html")).alias("escaped"))


def previews(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return t.texts(spark, sf, "documents").select(
        "doc_id", tx.preview(text).alias("web"), tx.tree_preview(text).alias("tree"))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Model replies built from chat turns: lists, a non-list, mixed items, prose, bad JSON."""
    word = F.regexp_replace("text", "[^A-Za-z]", "")
    n = F.col("turn")
    made = (
        F.when(n % 5 == 0, F.concat(F.lit('Sure! {"synonyms": ["'), word, F.lit('", "", "b"], "related": ["c"]} ok')))
        .when(n % 5 == 1, F.concat(F.lit('{"synonyms": "'), word, F.lit('", "related": ["x", 7, null, true, "y"]}')))
        .when(n % 5 == 2, F.concat(F.lit("no list for "), word))
        .when(n % 5 == 3, F.concat(F.lit('{"synonyms": ["'), word, F.lit('"'), F.lit("}")))
        .otherwise(F.concat(F.lit('{\n "related": [],\n "synonyms": ["'), word, F.lit('"]\n}'))))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", "text", made.alias("reply"))


def expand_query_parse(spark: SparkSession, sf: str) -> DataFrame:
    syn, rel = tx.expansion_terms(F.col("reply"), "synonyms"), tx.expansion_terms(F.col("reply"), "related")
    parsed = _replies(spark, sf).withColumn("synonyms", syn).withColumn("related", rel)
    return parsed.select("conv_id", "turn", "synonyms", "related",
                         tx.expanded_query(F.col("text"), F.col("synonyms"), F.col("related")).alias("expanded"))


def event_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Expansion parsing of every event: a list of two, a text where a list should be, or JSON with neither."""
    reply = (F.when(F.col("user_id") % 3 == 0, F.concat(F.lit('{"synonyms": ["'), "event_type", F.lit('", "again"]}')))
             .when(F.col("user_id") % 3 == 1, F.concat(F.lit('{"synonyms": "'), "event_type", F.lit('"}')))
             .otherwise(F.col("props")))
    syn = tx.expansion_terms(reply, "synonyms")
    return t.table(spark, sf, "events").groupBy("event_type").agg(
        F.sum(F.size(syn)).alias("terms"), F.count(F.lit(1)).alias("replies"))


QUERIES = {f.__name__: f for f in (
    split_identifiers_query, split_identifiers_index, tokenize, token_estimate, identifier_name, embedding_input,
    type_names, html_escape, previews, expand_query_parse, event_replies)}

# -- SQL --------------------------------------------------------------------------------

_WS = fv.WS


def sql_split(text: str, hyphens: bool) -> str:
    out = f"regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    out = f"replace({out}, '_', ' ')"
    if hyphens:
        out = f"replace({out}, '-', ' ')"
    return sql_trim(f"regexp_replace({out}, '{_WS}+', ' ', 'g')")


def sql_trim(text: str) -> str:
    return f"regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g')"


def sql_tokens(text: str) -> str:
    out = f"regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    out = f"lower(regexp_replace({out}, '[_\\-./\\\\]', ' ', 'g'))"
    return f"list_filter(string_split_regex({out}, '{_WS}+'), lambda x: length(x) > 1)"


def sql_case(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def sql_name(text: str, kind: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN nullif(regexp_extract({text}, '{p}', 1), '')" for k, p in fv.IDENTIFIER_NAME.items())
    return f"CASE {kind} {cases} END"


_UNITS = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
_SQUEEZED = "length(regexp_replace(text, '[ \\t]+', ' ', 'g'))"
_NEWLINES = "(length(text) - length(replace(text, chr(10), '')))"
_KINDS = t.sql_list(fv.CHUNK_TYPES)
_N = len(fv.CHUNK_TYPES)
_LABEL = sql_case("type", fv.TYPE_LABELS, "type")

_REPLIES = """replies AS (
  SELECT conv_id, turn, text, regexp_replace(text, '[^A-Za-z]', '', 'g') AS word FROM conversations),
made AS (SELECT *, CASE turn % 5
  WHEN 0 THEN 'Sure! {"synonyms": ["' || word || '", "", "b"], "related": ["c"]} ok'
  WHEN 1 THEN '{"synonyms": "' || word || '", "related": ["x", 7, null, true, "y"]}'
  WHEN 2 THEN 'no list for ' || word
  WHEN 3 THEN '{"synonyms": ["' || word || '"' || '}'
  ELSE '{' || chr(10) || ' "related": [],' || chr(10) || ' "synonyms": ["' || word || '"]' || chr(10) || '}' END AS reply
  FROM replies),
blocks AS (SELECT *, regexp_extract(reply, '(?s)\\{.*\\}', 0) AS raw FROM made),
checked AS (SELECT *, CASE WHEN raw <> '' AND json_valid(raw) THEN raw END AS block FROM blocks)"""


def _sql_terms(key: str) -> str:
    items = f"json_extract(block, '$.{key}')"
    return (f"CASE WHEN block IS NOT NULL AND json_type({items}) = 'ARRAY' THEN "
            f"list_filter(list_transform(list_filter(json_extract(block, '$.{key}[*]'), "
            "lambda j: json_type(j) = 'VARCHAR'), lambda j: json_extract_string(j, '$')), lambda s: length(s) > 0) "
            "ELSE [] END")


ORACLES = {
    "split_identifiers_query": f"""SELECT page_id, 'search_query: ' || {sql_split('url', True)} AS url_query,
      {sql_split('html', True)} AS html_plain FROM pages""",
    "split_identifiers_index": f"""SELECT page_id, 'search_document: ' || {sql_split('url', False)} AS url_document,
      {sql_split('html', False)} AS html_split FROM pages""",
    "tokenize": f"SELECT page_id, {sql_tokens('url')} AS url_tokens, {sql_tokens('html')} AS html_tokens FROM pages",
    "token_estimate": f"""SELECT doc_id, {_UNITS}::INTEGER AS units,
      CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor({_SQUEEZED} / 3.5::DOUBLE + {_NEWLINES} * 0.3::DOUBLE + 0.5::DOUBLE)::INTEGER) END AS estimate,
      CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, ceil({_UNITS} / 4)::INTEGER) END AS simple FROM documents""",
    "identifier_name": f"""WITH {t.SQL_UNITS},
      code_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                            unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line_no FROM source_files),
      typed AS (SELECT *, ({_KINDS})[((doc_id + line_no) % {_N} + 1)::INTEGER] AS type FROM code_lines)
      SELECT doc_id, line_no, type, {sql_name('line', 'type')} AS name FROM typed""",
    "embedding_input": f"""WITH {t.SQL_UNITS},
      typed AS (SELECT *, ({_KINDS})[(doc_id % {_N} + 1)::INTEGER] AS type FROM source_files)
      SELECT doc_id, concat_ws(chr(10), '[' || upper(language) || ']', regexp_extract(file_path, '[^/]*$', 0), {_LABEL},
        'Name: ' || {sql_name('text', 'type')}, '', text) AS input FROM typed""",
    "type_names": f"""WITH {t.SQL_DOCUMENT_CHUNKS}
      SELECT doc_id, {_LABEL} AS label, {sql_case('type', fv.TYPE_PLURALS, 'type')} AS plural,
        {sql_case('type', fv.TYPE_ICONS, "'symbol-misc'")} AS icon,
        CASE type {' '.join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fv.TYPE_BONUS.items())} ELSE 0.5::DOUBLE END AS bonus
      FROM document_chunks""",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
      chr(160), '&nbsp;') AS escaped FROM pages""",
    "previews": f"""WITH c AS (SELECT doc_id, text, {sql_trim(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} AS one FROM documents)
      SELECT doc_id, substr(one, 1, 100) AS web,
        substr(one, 1, 60) || CASE WHEN length(text) > 60 THEN '...' ELSE '' END AS tree FROM c""",
    "expand_query_parse": f"""WITH {_REPLIES},
      terms AS (SELECT conv_id, turn, text, {_sql_terms('synonyms')} AS synonyms, {_sql_terms('related')} AS related FROM checked)
      SELECT conv_id, turn, synonyms, related,
        array_to_string(list_concat([text], list_concat(synonyms, related)), ' ') AS expanded FROM terms""",
    "event_replies": """SELECT event_type, sum(CASE WHEN user_id % 3 = 0 THEN 2
        WHEN user_id % 3 = 2 AND json_type(props, '$.synonyms') = 'ARRAY' THEN 1 ELSE 0 END)::BIGINT AS terms,
      count(*) AS replies FROM events GROUP BY event_type""",
}
