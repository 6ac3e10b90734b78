"""Chunking queries: lines, cuts, splits, syntax chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek import fixed_values as fv
from lumenseek.catalog import tables as t
from lumenseek.catalog.text import sql_trim
from lumenseek.operators import cutting as cut
from lumenseek.operators.syntax import scan_syntax, top_level_kinds
from lumenseek.plans.chunking import chunk_errors, chunk_files, fallback_chunks

FIXED_LINES = 10
SPLIT = (12, 3, 6)
SMALL = 4
OVERLAP = 2


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return t.source_files(spark, sf)


def _rows(staged: DataFrame, array: str, key: str = "doc_id") -> DataFrame:
    """One row per piece: start line, end line, text."""
    out = staged.select(key, F.posexplode_outer(array).alias("n", "p")).where(F.col("n").isNotNull())
    return out.select(key, "n", F.col("p.start").alias("start_line"),
                      (F.col("p.start") + F.size("p.lines") - 1).alias("end_line"),
                      cut.join_lines(F.col("p.lines")).alias("text"))


def _scanned(spark: SparkSession, sf: str) -> DataFrame:
    staged = scan_syntax(_files(spark, sf))
    staged = staged.withColumn("grouped", cut.group_imports(F.col("points")))
    staged = staged.withColumn("breaks", cut.lift_over_comments(cut.first_per_line(F.col("grouped")), F.col("comments")))
    return staged.withColumn("pieces", cut.cut(F.col("lines"), F.col("breaks")))


def line_explode(spark: SparkSession, sf: str) -> DataFrame:
    return cut.explode_lines(t.table(spark, sf, "documents").select("doc_id", "text"))


def fixed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.texts(spark, sf, "documents").withColumn("lines", cut.split_lines(F.col("text")))
    return _rows(docs.withColumn("pieces", cut.fixed_cut(F.col("lines"), FIXED_LINES)), "pieces")


def breakpoint_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut at every line that starts with A to M."""
    docs = t.texts(spark, sf, "documents").withColumn("lines", cut.split_lines(F.col("text")))
    marked = F.transform("lines", lambda line, i: F.when(line.rlike("^[A-M]"), F.struct(
        i.alias("line"), F.lit(None).cast("string").alias("label"))))
    docs = docs.withColumn("breaks", F.array_compact(marked))
    return _rows(docs.withColumn("pieces", cut.cut(F.col("lines"), F.col("breaks"))), "pieces")


def split_large_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Whole source files split under a small line cap."""
    files = _files(spark, sf).withColumn("lines", cut.split_lines(F.col("text")))
    none = F.array().cast("array<struct<line:int,label:string>>")
    files = files.withColumn("pieces", cut.cut(F.col("lines"), none))
    return _rows(files.withColumn("parts", cut.split_large(F.col("pieces"), *SPLIT)), "parts")


def syntax_points(spark: SparkSession, sf: str) -> DataFrame:
    points = _scanned(spark, sf).select("doc_id", F.explode_outer("points").alias("p")).where("p is not null")
    return points.select("doc_id", "p.line", "p.label")


def import_grouping(spark: SparkSession, sf: str) -> DataFrame:
    points = _scanned(spark, sf).select("doc_id", F.explode_outer("grouped").alias("p")).where("p is not null")
    return points.select("doc_id", "p.line", "p.label")


def comment_breakpoints(spark: SparkSession, sf: str) -> DataFrame:
    points = _scanned(spark, sf).select("doc_id", F.explode_outer("breaks").alias("p")).where("p is not null")
    return points.select("doc_id", "p.line", "p.label")


def small_chunk_merge(spark: SparkSession, sf: str) -> DataFrame:
    staged = _scanned(spark, sf)
    return _rows(staged.withColumn("merged", cut.merge_small(F.col("pieces"), SMALL)), "merged")


def chunk_overlap(spark: SparkSession, sf: str) -> DataFrame:
    staged = _scanned(spark, sf).withColumn("wide", cut.add_overlap(F.col("pieces"), OVERLAP))
    out = _rows(staged, "wide")
    return out.select("doc_id", "n", "start_line", "text")


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered pieces with recounted lines."""
    staged = _scanned(spark, sf).withColumn("meta", cut.with_metadata(F.col("pieces")))
    out = staged.select("doc_id", F.explode_outer("meta").alias("m")).where("m is not null")
    return out.select("doc_id", "m.chunk_number", "m.code", "m.start_line", "m.end_line")


def consolidated(spark: SparkSession, sf: str) -> DataFrame:
    staged = _scanned(spark, sf).withColumn("joined", cut.consolidate(F.col("pieces")))
    return staged.select("doc_id", cut.count_lines(F.col("joined")).alias("n_lines"), F.md5("joined").alias("digest"))


def content_type_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed pieces of source files, typed by their content alone."""
    return fallback_chunks(_files(spark, sf).drop("doc_id"), 3).select("id", "type", "text")


def content_type_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages typed by content as if they were tsx, vue and css."""
    pages = t.texts(spark, sf, "pages").withColumn("lines", cut.split_lines(F.col("html")))
    return pages.select("page_id", *[
        cut.content_type(F.col("lines"), F.lit(ext)).alias(f"as_{ext}") for ext in ("tsx", "ts", "vue", "css")])


_SHOWN = ["id", "file_path", "start_line", "end_line", "text", "type", "language", "chunk_index_in_file"]


def chunk_source_code(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(_files(spark, sf), timestamp=0).select(*_SHOWN)


def chunk_source_code_compat(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(_files(spark, sf), timestamp=0, compat=True).select(*_SHOWN)


def variable_merge(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_files(_files(spark, sf), timestamp=0).where(F.col("type") == "variable").select(
        "id", "start_line", "end_line", "text")


HEAD = "<template>\n<p>{{ title }}</p>\n</template>\n<!-- logic -->\n<script>\n"
TAIL = "\n</script>\n<style>\np { margin: 0 }\n</style>\n"


def _components(spark: SparkSession, sf: str) -> DataFrame:
    files = _files(spark, sf)
    return files.select("doc_id", F.regexp_replace("file_path", "ts$", "vue").alias("file_path"),
                        F.lit("vue").alias("language"), F.concat(F.lit(HEAD), "text", F.lit(TAIL)).alias("text"))


def chunk_components(spark: SparkSession, sf: str) -> DataFrame:
    """The derived files as the script block of single-file components."""
    return chunk_files(_components(spark, sf), timestamp=0).select(*_SHOWN)


def chunk_css(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as style sheets."""
    return chunk_files(t.source_files(spark, sf, "text", t.CSS_TEMPLATES, "css"), timestamp=0).select(*_SHOWN)


def chunk_tsx(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as components with markup."""
    return chunk_files(t.source_files(spark, sf, "text", t.TSX_TEMPLATES, "tsx"), timestamp=0).select(*_SHOWN)


OPTIONS_HEAD = ("<script>\nexport default {\n  props: ['a'],\n  emits: ['go'],\n  data() {\n    return {};\n  },\n  methods: {\n")
#: What stands between the sections of members, which are the same in each.
OPTION_SECTIONS = {"methods": "Vue Methods Method", "computed": "Vue Computed Method", "watch": "Vue Watch Method"}
OPTIONS_TAIL = "\n  },\n" + "".join(f"  {hook}() {{\n    go();\n  }},\n" for hook in fv.LIFECYCLE_HOOKS) + "};\n</script>\n"


def _options_parts(text: str) -> list[str]:
    """The parts of a component around and with its members, which are called ``text``."""
    between = [f"\n  }},\n  {name}: {{\n" for name in list(OPTION_SECTIONS)[1:]]
    return [OPTIONS_HEAD, text, *[part for gap in between for part in (gap, text)], OPTIONS_TAIL]


def chunk_options(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as components: every section has a member for every line, and there is every hook."""
    files = t.source_files(spark, sf, "text", t.OPTION_TEMPLATES, "vue")
    whole = F.concat(*[F.col("text") if part == "text" else F.lit(part) for part in _options_parts("text")])
    return chunk_files(files.withColumn("text", whole), timestamp=0).select(*_SHOWN)


def top_node_kinds(spark: SparkSession, sf: str) -> DataFrame:
    kinds = top_level_kinds(scan_syntax(_files(spark, sf)))
    return kinds.select("file_path", F.explode_outer("kinds").alias("k")).where("k is not null").groupBy("k.kind").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_distinct("file_path").alias("files"))


def unsupported_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of mixed kinds: English ones as scripts, German ones as style sheets, the rest unknown."""
    docs = t.document_chunks(spark, sf)
    kind = F.when(F.col("language") == "en", "ts").when(F.col("language") == "de", "css").otherwise(F.col("language"))
    return chunk_errors(docs.select(F.col("id").alias("file_path"), kind.alias("language")))


QUERIES = {f.__name__: f for f in (
    line_explode, fixed_chunks, breakpoint_chunks, split_large_chunks, syntax_points, import_grouping,
    comment_breakpoints, small_chunk_merge, chunk_overlap, chunk_metadata, consolidated, content_type_fallback,
    content_type_pages, chunk_source_code, chunk_source_code_compat, variable_merge, chunk_components,
    chunk_css, chunk_tsx, chunk_options, top_node_kinds, unsupported_files)}

# -- SQL: known templates give known points, windows do the rest ---------------------------------

_WS = fv.WS


def _values(known: dict = t.CODE_POINTS) -> str:
    rows, seq = [], 0
    for kind, points in known.items():
        for offset, label in points:
            rows.append(f"({kind}, {offset}, {seq}, '{label}')")
            seq += 1
    return ", ".join(rows)


def _sql_files(units: str, known: dict, marks: dict) -> str:
    return f"""{units},
files AS (SELECT doc_id, file_path, language, text FROM source_files),
known(kind, off, seq, label) AS (VALUES {_values(known)}),
pts AS (SELECT doc_id, start_row + off AS line, i * 100 + seq AS seq, label FROM units JOIN known USING (kind)),
marked(kind, off) AS (VALUES {", ".join(f"({k}, {off})" for k, offsets in marks.items() for off in offsets)}),
marks AS (SELECT doc_id, start_row + off AS line FROM units JOIN marked USING (kind))"""


_TS_FILES = _sql_files(t.SQL_UNITS, t.CODE_POINTS, t.CODE_MARKS)
_CSS_FILES = _sql_files(t.sql_units(t.CSS_TEMPLATES, "css"), t.CSS_POINTS, {t.COMMENT_KIND: [0]})
_TSX_FILES = _sql_files(t.sql_units(t.TSX_TEMPLATES, "tsx"), t.TSX_POINTS, {t.COMMENT_KIND: [0]})

_OFFSET = HEAD.count("\n")
_sql_text = "'" + HEAD.replace("\n", "' || chr(10) || '") + "' || text || '" + TAIL.replace("\n", "' || chr(10) || '") + "'"
_VUE_FILES = f"""{t.SQL_UNITS},
files AS (SELECT doc_id, replace(file_path, '.ts', '.vue') AS file_path, 'vue' AS language, {_sql_text} AS text
          FROM source_files),
known(kind, off, seq, label) AS (VALUES {_values()}),
sizes AS (SELECT doc_id, len(string_split(text, chr(10))) AS nl FROM source_files),
pts AS (
  SELECT doc_id, start_row + off + {_OFFSET} AS line, i * 100 + seq AS seq, label FROM units JOIN known USING (kind)
  WHERE label NOT IN ('Interface', 'Type Alias')
  UNION ALL SELECT doc_id, 0, -3, 'Template' FROM files
  UNION ALL SELECT doc_id, {_OFFSET - 1}, -2, 'Script' FROM files
  UNION ALL SELECT doc_id, {_OFFSET} + nl + 1, 1000000000, 'Style' FROM sizes),
marks AS (SELECT doc_id, 3 AS line FROM files)"""

_options_text = " || ".join("text" if part == "text" else "'" + part.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
                            for part in _options_parts("text"))
_OPTIONS_AT = OPTIONS_HEAD.count("\n")
_sections = ", ".join(f"({k}, '{label}')" for k, label in enumerate(OPTION_SECTIONS.values()))
_hooks = ", ".join(f"({k})" for k in range(len(fv.LIFECYCLE_HOOKS)))
_OPTION_FILES = f"""{t.sql_units(t.OPTION_TEMPLATES, "vue")},
files AS (SELECT doc_id, file_path, language, {_options_text} AS text FROM source_files),
known(kind, off, seq, label) AS (VALUES {_values(t.OPTION_POINTS)}),
sizes AS (SELECT doc_id, len(string_split(text, chr(10))) AS nl FROM source_files),
sections(k, name) AS (VALUES {_sections}), hooks(k) AS (VALUES {_hooks}),
pts AS (
  SELECT doc_id, start_row + off + {_OPTIONS_AT} + k * (nl + 2) AS line, k * 1000000000 + i * 100 + seq AS seq, name AS label
  FROM units JOIN known USING (kind) JOIN sizes USING (doc_id) CROSS JOIN sections
  UNION ALL SELECT doc_id, 0, -5, 'Script' FROM files
  UNION ALL SELECT doc_id, 1, -4, 'Export' FROM files
  UNION ALL SELECT doc_id, 2, -3, 'Props Definition' FROM files
  UNION ALL SELECT doc_id, 3, -2, 'Emits Definition' FROM files
  UNION ALL SELECT doc_id, 4, -1, 'Data Function' FROM files
  UNION ALL SELECT doc_id, {_OPTIONS_AT} + 3 * nl + 5 + 3 * k, 5000000000 + k, 'Lifecycle Hook' FROM sizes CROSS JOIN hooks),
marks AS (SELECT doc_id, 0 AS line FROM files WHERE false)"""

_STEPS = """flagged AS (
  SELECT *, label IN ('Import', 'Export') AS imp,
         coalesce(lag(label IN ('Import', 'Export')) OVER (PARTITION BY doc_id ORDER BY line, seq), false) AS pimp FROM pts),
grouped AS (SELECT * FROM flagged WHERE NOT (imp AND pimp)),
firsts AS (SELECT doc_id, line, arg_min(label, seq) AS label FROM grouped GROUP BY doc_id, line),
runs AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM marks),
islands AS (SELECT doc_id, min(line) AS head, max(line) AS last FROM runs GROUP BY doc_id, run),
moved AS (
  SELECT f.doc_id, coalesce(i.head, f.line) AS line, f.line AS origin, f.label FROM firsts f
  LEFT JOIN islands i ON i.doc_id = f.doc_id AND f.line - 1 BETWEEN i.head AND i.last),
breaks AS (SELECT doc_id, line, arg_max(label, origin) AS label FROM moved GROUP BY doc_id, line),
starts AS (
  SELECT doc_id, line, label FROM breaks
  UNION ALL SELECT doc_id, 0, NULL FROM files WHERE doc_id NOT IN (SELECT doc_id FROM breaks WHERE line = 0)),
split_files AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM files),
spans AS (
  SELECT s.doc_id, line AS start, label, lines,
         lead(line, 1, len(lines)) OVER (PARTITION BY s.doc_id ORDER BY line) AS stop
  FROM starts s JOIN split_files f ON f.doc_id = s.doc_id),
raw_pieces AS (SELECT *, array_to_string(lines[start + 1:stop], chr(10)) AS code FROM spans),
pieces AS (
  SELECT doc_id, start::INTEGER AS start, stop::INTEGER AS stop, label, code, lines,
         (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INTEGER AS n,
         (sum(stop - start) OVER (PARTITION BY doc_id ORDER BY start) - (stop - start))::INTEGER AS counted
  FROM raw_pieces WHERE """ + f"{sql_trim('code')} <> '')"


def _line_pattern(pattern: str) -> str:
    return pattern.replace(r"[\s>]", f"[{_WS[1:-1]}>]").replace(r"\s", _WS)


def sql_content_type(lines: str, language: str) -> str:
    cases = []
    for extensions, kind, patterns in fv.CONTENT_RULES:
        regex = "|".join(f"(?:{_line_pattern(p)})" for p in patterns)
        languages = ", ".join(f"'{e}'" for e in extensions)
        cases.append(f"WHEN {language} IN ({languages}) AND "
                     f"len(list_filter({lines}, lambda x: regexp_matches(x, '{regex}'))) > 0 THEN '{kind}'")
    return "CASE " + " ".join(cases) + " ELSE 'block' END"


_SYNTAX = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.SYNTAX_TYPES.items()) + " ELSE 'block' END"


def sql_chunks(files: str, compat: bool = False) -> str:
    placed = ("""placed AS (
  SELECT p.doc_id, p.counted AS start, p.counted + p.stop - p.start AS stop, b.label, p.code, p.lines, p.n
  FROM pieces p LEFT JOIN breaks b ON b.doc_id = p.doc_id AND b.line = p.counted)""" if compat else
              "placed AS (SELECT * FROM pieces)")
    return f"""WITH {files}, {_STEPS}, {placed},
typed AS (
  SELECT p.*, f.file_path, f.language, CASE WHEN label IS NOT NULL THEN {_SYNTAX}
    ELSE {sql_content_type("string_split(code, chr(10))", 'f.language')} END AS type
  FROM placed p JOIN files f ON f.doc_id = p.doc_id),
joined AS (
  SELECT *, CASE WHEN type = 'variable' AND lag(type) OVER w = 'variable' AND start - lag(stop) OVER w <= 2
    THEN 0 ELSE 1 END AS fresh FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY n) AS grp FROM joined),
merged AS (
  SELECT doc_id, file_path, language, type, grp, min(start) AS s, max(stop) AS e,
         CASE WHEN count(*) = 1 THEN any_value(code)
              ELSE array_to_string(any_value(lines)[min(start) + 1:max(stop)], chr(10)) END AS code
  FROM numbered GROUP BY doc_id, file_path, language, type, grp),
chunk_rows AS (
  SELECT file_path || ':' || (s + 1) || '-' || e AS id, file_path, (s + 1)::INTEGER AS start_line, e::INTEGER AS end_line,
         {sql_trim('code')} AS text, type, language,
         (row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1)::INTEGER AS chunk_index_in_file FROM merged)"""


_PIECES = f"WITH {_TS_FILES}, {_STEPS}"
_KINDS = ", ".join(f"('{k}', '{v}')" for k, v in (
    ("Import", "import_statement"), ("Export", "export_statement"), ("Function", "function_declaration"),
    ("Class", "class_declaration"), ("Interface", "interface_declaration"), ("Type Alias", "type_alias_declaration"),
    ("Variable", "lexical_declaration")))
_CAP, _FLOOR, _BACK = SPLIT
_ENDS = ("list_transform(lines, lambda x: trim(x, ' ' || chr(9)) IN ('', '}', '};') OR (ends_with(trim(x, ' ' || chr(9)), ';') "
         "AND NOT contains(x, 'for') AND NOT contains(x, 'if')))")

ORACLES = {
    "line_explode": """SELECT doc_id, (unnest(range(len(string_split(text, chr(10))))))::INTEGER AS line_no,
      unnest(string_split(text, chr(10))) AS line FROM documents""",
    "fixed_chunks": f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
        unnest(string_split(text, chr(10))) AS line FROM documents),
      p AS (SELECT doc_id, i // {FIXED_LINES} AS g, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS text
            FROM l GROUP BY doc_id, i // {FIXED_LINES})
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS n, s::INTEGER AS start_line,
        e::INTEGER AS end_line, text FROM p WHERE {sql_trim('text')} <> ''""",
    "breakpoint_chunks": f"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i,
        unnest(string_split(text, chr(10))) AS line FROM documents),
      m AS (SELECT *, sum(regexp_matches(line, '^[A-M]')::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
      p AS (SELECT doc_id, g, min(i) AS s, max(i) AS e, string_agg(line, chr(10) ORDER BY i) AS text FROM m GROUP BY doc_id, g)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS n, s::INTEGER AS start_line,
        e::INTEGER AS end_line, text FROM p WHERE {sql_trim('text')} <> ''""",
    "split_large_chunks": f"""WITH RECURSIVE {t.SQL_UNITS},
      f AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM source_files WHERE {sql_trim('text')} <> ''),
      e AS (SELECT doc_id, lines, len(lines) AS size, {_ENDS} AS ends FROM f),
      cuts AS (
        SELECT doc_id, 0::BIGINT AS s FROM e
        UNION ALL
        SELECT c.doc_id, coalesce(list_max(list_filter(range(greatest(c.s + {_FLOOR}, c.s + {_CAP} - {_BACK}), c.s + {_CAP}),
                 lambda k: ends[k + 1])) + 1, c.s + {_CAP})
        FROM cuts c JOIN e USING (doc_id) WHERE size - c.s > {_CAP}),
      spans AS (SELECT doc_id, s, lead(s, 1, size) OVER (PARTITION BY doc_id ORDER BY s) AS stop, lines FROM cuts JOIN e USING (doc_id)),
      p AS (SELECT doc_id, s, stop, array_to_string(lines[s + 1:stop], chr(10)) AS text FROM spans)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS n, s::INTEGER AS start_line,
        (stop - 1)::INTEGER AS end_line, text FROM p WHERE {sql_trim('text')} <> ''""",
    "syntax_points": f"WITH {_TS_FILES} SELECT doc_id, line, label FROM pts",
    "import_grouping": f"{_PIECES} SELECT doc_id, line, label FROM grouped",
    "comment_breakpoints": f"{_PIECES} SELECT doc_id, line, label FROM breaks",
    "small_chunk_merge": f"""WITH RECURSIVE {_TS_FILES}, {_STEPS},
      sized AS (SELECT *, stop - start AS k, count(*) OVER (PARTITION BY doc_id) AS total FROM pieces),
      walk AS (
        SELECT doc_id, n, total, false AS taken FROM sized WHERE n = 0
        UNION ALL
        SELECT s.doc_id, s.n, s.total, p.k < {SMALL} AND NOT w.taken OR (s.n = s.total - 1 AND s.k < {SMALL})
        FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.n = w.n + 1 JOIN sized p ON p.doc_id = w.doc_id AND p.n = w.n),
      grp AS (SELECT *, sum((NOT taken)::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM walk),
      m AS (SELECT p.doc_id, g, min(start) AS s, string_agg(code, chr(10) ORDER BY p.n) AS text, sum(k) AS k
            FROM grp JOIN sized p ON p.doc_id = grp.doc_id AND p.n = grp.n GROUP BY p.doc_id, g)
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS n, s AS start_line,
        (s + k - 1)::INTEGER AS end_line, text FROM m""",
    "chunk_overlap": f"""{_PIECES} SELECT doc_id, n, start AS start_line,
      coalesce(array_to_string(string_split(lag(code) OVER w, chr(10))[-{OVERLAP}:], chr(10)) || chr(10), '') || code AS text
      FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY n)""",
    "chunk_metadata": f"""{_PIECES} SELECT doc_id, n + 1 AS chunk_number, code, counted AS start_line,
      (counted + stop - start - 1)::INTEGER AS end_line FROM pieces""",
    "consolidated": f"""{_PIECES}, j AS (SELECT f.doc_id, coalesce(string_agg(code, chr(10) ORDER BY n), '') AS text
        FROM files f LEFT JOIN pieces p ON p.doc_id = f.doc_id GROUP BY f.doc_id)
      SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS n_lines, md5(text) AS digest FROM j""",
    "content_type_fallback": f"""WITH {t.SQL_UNITS},
      l AS (SELECT file_path, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line
            FROM source_files),
      p AS (SELECT file_path, min(i) AS s, max(i) AS e, list(line ORDER BY i) AS lines FROM l GROUP BY file_path, i // 3)
      SELECT file_path || ':' || (s + 1) || '-' || (e + 1) AS id, {sql_content_type('lines', "'ts'")} AS type,
        {sql_trim('array_to_string(lines, chr(10))')} AS text FROM p
      WHERE {sql_trim('array_to_string(lines, chr(10))')} <> ''""",
    "content_type_pages": "WITH p AS (SELECT page_id, string_split(html, chr(10)) AS lines FROM pages) SELECT page_id, " + ", ".join(
        f"""{sql_content_type('lines', f"'{ext}'")} AS as_{ext}""" for ext in ("tsx", "ts", "vue", "css")) + " FROM p",
    "chunk_source_code": f"{sql_chunks(_TS_FILES)} SELECT * FROM chunk_rows",
    "chunk_source_code_compat": f"{sql_chunks(_TS_FILES, True)} SELECT * FROM chunk_rows",
    "variable_merge": f"{sql_chunks(_TS_FILES)} SELECT id, start_line, end_line, text FROM chunk_rows WHERE type = 'variable'",
    "chunk_components": f"{sql_chunks(_VUE_FILES)} SELECT * FROM chunk_rows",
    "chunk_css": f"{sql_chunks(_CSS_FILES)} SELECT * FROM chunk_rows",
    "chunk_tsx": f"{sql_chunks(_TSX_FILES)} SELECT * FROM chunk_rows",
    "chunk_options": f"{sql_chunks(_OPTION_FILES)} SELECT * FROM chunk_rows",
    "top_node_kinds": f"""WITH {_TS_FILES}, k(label, kind) AS (VALUES {_KINDS})
      SELECT kind, count(*) AS nodes, count(DISTINCT doc_id) AS files FROM pts JOIN k USING (label) GROUP BY kind""",
    "unsupported_files": f"""WITH {t.SQL_DOCUMENT_CHUNKS}
      SELECT id AS file_path, 'Unsupported file extension: ' || language AS error FROM document_chunks
      WHERE language NOT IN ('en', 'de')""",
}
