"""How the given tables stand in for a code base, in Spark and in SQL.

Every view reads whole tables, so the work of each query grows with them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.operators.cutting import split_lines
from lumenseek.providers.embedding import HashProvider
from lumenseek.providers.models import EmbeddingModel
from lumenseek.session import deal, spread

DIMENSIONS = 64

#: Search texts used as query parameters (not as data).
QUERY_TEXT = "the thereThe src1 of the and text"
QUERY_TEXTS = {
    "q1": "parse the query and rank results",
    "q2": "load user settings",
    "q3": "render list of files",
    "q4": "retry failed requests",
    "q5": "count lines in a document",
}
KEYWORD = "the"


#: Letters one by one are a set to the pattern matcher; ranges would be compared in turn at every character.
_NOT_LETTERS = f"[^{string.ascii_letters} ]+"

#: Declared, so that opening a table starts no job to look at file footers.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts for heavy text work: on every core even if it is one small file."""
    return spread(table(spark, sf_dir, name))


def query_vector(text: str) -> list[float]:
    """Unit vector of a query text by the offline provider."""
    return HashProvider(DIMENSIONS).embed([text])[0]


def sql_list(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in values) + "]"


# -- chunks: one chunk per document that has an embedding -------------------------------

def chunk_type_of(doc_id: Column) -> Column:
    kinds = F.array(*[F.lit(t) for t in fv.CHUNK_TYPES])
    return F.element_at(kinds, (doc_id % len(fv.CHUNK_TYPES) + 1).cast("int"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-chunk pieces of 'files' named after their source."""
    text = F.col("text")
    end = F.size(split_lines(text))
    path = F.concat(F.lit("/ws/"), F.col("source"), F.lit("."), F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(path, F.lit(":"), F.col("doc_id").cast("string")).alias("id"),
        path.alias("file_path"), F.lit(1).alias("start_line"), end.alias("end_line"), text,
        chunk_type_of(F.col("doc_id")).alias("type"), F.col("lang").alias("language"))


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return document_chunks(spark, sf_dir).join(vectors, "doc_id").drop("doc_id")


_TYPES = sql_list(fv.CHUNK_TYPES)

SQL_DOCUMENT_CHUNKS = f"""document_chunks AS (
  SELECT doc_id, '/ws/' || source || '.' || lang || ':' || doc_id AS id,
         '/ws/' || source || '.' || lang AS file_path, 1 AS start_line,
         len(string_split(text, chr(10)))::INTEGER AS end_line, text,
         ({_TYPES})[(doc_id % {len(fv.CHUNK_TYPES)} + 1)::INTEGER] AS type, lang AS language
  FROM documents)"""

SQL_SEARCH_CHUNKS = SQL_DOCUMENT_CHUNKS + """,
chunks AS (
  SELECT c.*, e.embedding AS vector FROM document_chunks c JOIN embeddings e ON e.vec_id = c.doc_id)"""


def sql_d2(vector: str, query: str) -> str:
    return (f"list_sum(list_transform(list_zip({vector}, {query}), "
            "lambda p: (p[1]::DOUBLE - p[2]) * (p[1]::DOUBLE - p[2])))")


SQL_SIMILARITY = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - coalesce(d2, 0) / 2))"

# -- source files: every document line becomes a piece of TypeScript -----------------------

# Line kind -> template; {i} is the line number, {b} the line's own letters.
CODE_TEMPLATES = [
    'import {{ v{i} }} from "{b}";',
    'const v{i} = "{b}";',
    'function v{i}(a) {{\n  return a + "{b}";\n}}',
    'class V{i} {{\n  run(a) {{\n    return "{b}";\n  }}\n}}',
    'export const v{i} = (a) => {{\n  return "{b}";\n}};',
    "// {b}",
    "export {{ v{i} }};",
    "interface V{i} {{\n  name: string;\n}}",
    'type V{i} = "{b}";',
    'run("{b}");',
    'const v{i} = `x ${{b ? `{{` : "{b}"}} y`;',
    "function v{i}(s) {{\n  return /[{{(]/.test(s);\n}}",
    'class V{i}\n{{\n  run(a)\n  {{\n    return "{b}";\n  }}\n}}',
    'function* v{i}() {{\n  yield "{b}";\n}}',
    'const v{i} = "{b}"; function w{i}(a) {{ return a; }}',
    'class V{i} {{ run(a) {{ return "{b}"; }} stop() {{}} }}',
    '@Part({{\n  name: "{b}",\n}})\nclass V{i} {{\n  @Bound("{b}", [\n    1,\n  ])\n  run(a) {{\n  }}\n}}',
    "",
]
#: Line kind -> syntax points as (line offset, label), in visit order.
CODE_POINTS = {
    0: [(0, "Import")], 1: [(0, "Variable")], 2: [(0, "Function")],
    3: [(0, "Class"), (1, "Function")], 4: [(0, "Export"), (0, "Function")],
    6: [(0, "Export")], 7: [(0, "Interface")], 8: [(0, "Type Alias")],
    10: [(0, "Variable")], 11: [(0, "Function")], 12: [(0, "Class"), (2, "Function")],
    14: [(0, "Variable"), (0, "Function")], 15: [(0, "Class"), (0, "Function"), (0, "Function")],
    16: [(3, "Class"), (7, "Function")],
}
COMMENT_KIND = 5
#: Lines of comments and of decorators, which breakpoints are lifted over.
CODE_MARKS = {COMMENT_KIND: [0], 16: [0, 1, 2, 4, 5, 6]}

#: The same for style sheets and for components with markup.
CSS_TEMPLATES = [
    ".v{i} {{\n  color: red;\n}}",
    "#v{i},\n.w{i} > a:hover {{ margin: 0; }}",
    "@media (max-width: {i}px) {{\n  .v{i} {{\n    color: red;\n  }}\n}}",
    "@keyframes v{i} {{\n  from {{ left: 0; }}\n}}",
    '@import "{b}.css";',
    "/* {b} */",
    '.q{i}::after {{ content: "{{ {b}"; }}',
    "",
]
CSS_POINTS = {0: [(0, "Rule")], 1: [(0, "Rule")], 2: [(0, "Media Query")], 3: [(0, "Keyframes")], 6: [(0, "Rule")]}
TSX_TEMPLATES = [
    'import {{ v{i} }} from "{b}";',
    "function V{i}() {{\n  return (\n    <p>{b}</p>\n  );\n}}",
    "const V{i} = (a: string) => {{\n  return a;\n}};",
    "function W{i}() {{\n  return <b>{b}</b>;\n}}",
    "interface P{i} {{\n  name: string;\n}}",
    "// {b}",
    "enum E{i} {{\n  A,\n}}",
    "const M{i} = <div>\n  <p>\n    {b}\n  </p>\n</div>;",
    "const N{i} = (\n  <div>\n    <p>{b}</p>\n  </div>\n);",
    "",
]
TSX_POINTS = {0: [(0, "Import")], 1: [(0, "Function"), (1, "JSX")], 2: [(0, "Function")], 3: [(0, "Function")],
              4: [(0, "Interface")], 6: [(0, "Enum")], 7: [(0, "Variable"), (0, "JSX"), (1, "JSX")],
              8: [(0, "Variable"), (1, "JSX")]}
#: Methods of a component's options object.
OPTION_TEMPLATES = ['    m{i}(a) {{\n      return "{b}";\n    }},', ""]
OPTION_POINTS = {0: [(0, "Vue Methods Method")]}


def _parts(template: str) -> list[tuple[str, str]]:
    """Split a template into ('text'|'i'|'b', value) parts."""
    out = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            out.append(("text", literal))
        if name:
            out.append((name, ""))
    return out


def source_files(spark: SparkSession, sf_dir: str, text: str = "text", templates: list[str] = CODE_TEMPLATES,
                 extension: str = "ts") -> DataFrame:
    """Every document as a source file, built line by line from its text; the last template is for blank lines."""
    blank = len(templates) - 1

    def facts(line: Column, i: Column) -> Column:
        kind = F.when(line == "", blank).otherwise((F.length(line) * 7 + i * 3) % blank)
        return F.struct(kind.alias("kind"), i.cast("string").alias("i"),
                        F.regexp_replace(line, _NOT_LETTERS, "").alias("b"))

    def unit(x: Column) -> Column:
        out = None
        for k, template in enumerate(templates):
            parts = [F.lit(v) if kind == "text" else x[kind] for kind, v in _parts(template)]
            made = F.concat(*parts) if parts else F.lit("")
            out = F.when(x["kind"] == k, made) if out is None else out.when(x["kind"] == k, made)
        return out

    docs = deal(table(spark, sf_dir, "documents"))
    code = F.array_join(F.transform(F.transform(split_lines(F.col("text")), facts), unit), "\n")
    path = F.concat(F.lit("/ws/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(f".{extension}"))
    return docs.select("doc_id", path.alias("file_path"), F.lit(extension).alias("language"), code.alias(text))


def _sql_unit(templates: list[str]) -> str:
    cases = []
    for k, template in enumerate(templates):
        parts = ["'" + v.replace("\n", "' || chr(10) || '") + "'" if t == "text" else
                 "i::VARCHAR" if t == "i" else "body" for t, v in _parts(template)]
        cases.append(f"WHEN {k} THEN {' || '.join(parts) or repr('')}")
    return "CASE kind " + " ".join(cases) + " END"


def sql_units(templates: list[str] = CODE_TEMPLATES, extension: str = "ts") -> str:
    """units: one row per document line with its kind, code and place in the file; source_files."""
    blank = len(templates) - 1
    return f"""doc_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
kinds AS (
  SELECT *, CASE WHEN line = '' THEN {blank} ELSE (length(line) * 7 + i * 3) % {blank} END AS kind,
         regexp_replace(line, '[^A-Za-z ]', '', 'g') AS body
  FROM doc_lines),
unit_code AS (SELECT *, {_sql_unit(templates)} AS code FROM kinds),
units AS (
  SELECT *, len(string_split(code, chr(10))) AS n_lines,
         (sum(len(string_split(code, chr(10)))) OVER (PARTITION BY doc_id ORDER BY i)
          - len(string_split(code, chr(10))))::INTEGER AS start_row
  FROM unit_code),
source_files AS (
  SELECT doc_id, '/ws/' || any_value(source) || '/doc_' || doc_id || '.{extension}' AS file_path, '{extension}' AS language,
         string_agg(code, chr(10) ORDER BY i) AS text
  FROM units GROUP BY doc_id)"""


SQL_UNITS = sql_units()

# -- hashed vectors of whole document texts ------------------------------------------------


def hash_model() -> EmbeddingModel:
    return HashProvider(DIMENSIONS).model
