from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import paths, scoring, text as tx
from lumenseek.providers import expansion, preparation
from lumenseek.providers.models import embedding_model, index_prepared

SPLITS = [
    ("getUserData", "get User Data", "get User Data"),
    ("XMLParser", "XML Parser", "XML Parser"),
    ("user_id", "user id", "user id"),
    ("kebab-case-name", "kebab-case-name", "kebab case name"),
    ("getXMLHttpRequest2Data", "get XML Http Request2Data", "get XML Http Request2Data"),
    (" a \tb﻿", "a b", "a b"),
]


def test_split_identifiers(column):
    words = [s[0] for s in SPLITS]
    assert column(lambda c: tx.split_identifiers(c, hyphens=False), words) == [s[1] for s in SPLITS]
    assert column(lambda c: tx.split_identifiers(c, hyphens=True), words) == [s[2] for s in SPLITS]
    assert [preparation.split_identifiers(w) for w in words] == [s[2] for s in SPLITS]
    assert [preparation.split_identifiers(w, hyphens=False) for w in words] == [s[1] for s in SPLITS]


def test_token_estimates(column):
    texts = ["", "a", "Hello, world!", "function add(a, b) { return a + b; }", "const myVariable = 123;", "a\nb\n\n\n",
             "x\t\t y"]
    assert column(tx.token_estimate, texts) == [0, 1, 4, 10, 7, 3, 1]
    assert column(tx.token_estimate_simple, texts) == [0, 1, 4, 9, 6, 2, 2]


def test_lengths_count_utf16_units(column):
    assert column(tx.utf16_length, ["a", "é", "😀", ""]) == [1, 1, 2, 0]


def test_tokenize_splits_case_and_drops_single_characters(column):
    texts = ["getUserData", "a.b/cd-ef_gh\\ij", "one one", "", "x 😀 yz"]
    want = [["get", "user", "data"], ["cd", "ef", "gh", "ij"], ["one", "one"], [], ["😀", "yz"]]
    assert column(tx.tokenize, texts) == want
    assert [preparation.tokenize(t) for t in texts] == want


def test_task_prefixes(column):
    nomic, large = embedding_model("ollama", "nomic-embed-text"), embedding_model("ollama", "mxbai-embed-large")
    assert column(lambda c: nomic.prepared(c, is_query=True), ["aB-c"]) == ["search_query: a B c"]
    assert column(lambda c: nomic.prepared(c), ["aB"]) == ["a B"]
    assert column(lambda c: large.prepared(c, is_query=True), ["aB"]) == ["a B"]
    assert column(index_prepared, ["aB-c"]) == ["search_document: a B-c"]
    assert nomic.prepare("aB-c", is_query=False) == "search_document: a B c"
    with pytest.raises(ValueError):
        embedding_model("ollama", "nope")


def test_identifier_names(spark):
    rows = [("function", "export function load_it(x)", "load_it"), ("class", "class Foo {", "Foo"),
            ("method", "async run (a)", "run"), ("const", "const $x = 1", "$x"), ("variable", "let y", "y"),
            ("interface", "interface I {}", "I"), ("type", "type T = 1", "T"),
            ("component", "export default function App()", "App"), ("component", "const app = 1", None),
            ("import", "import a from 'b'", None)]
    df = spark.createDataFrame(rows, "kind string, code string, name string")
    for r in df.withColumn("got", tx.identifier_name(F.col("code"), F.col("kind"))).collect():
        assert r.got == r.name, r


def test_embedding_input_keeps_the_blank_line(spark):
    df = spark.createDataFrame([("ts", "/a/b.ts", "function", "function f() {}"), ("ts", "/a/b.ts", "odd", "x")],
                               "language string, path string, type string, text string")
    got = [r[0] for r in df.select(tx.embedding_input(*map(F.col, df.columns))).collect()]
    assert got == ["[TS]\nb.ts\nFunction\nName: f\n\nfunction f() {}", "[TS]\nb.ts\nodd\n\nx"]


def test_previews_and_escape(column):
    long = "a\n  b " * 40
    assert column(tx.preview, [long])[0] == ("a b " * 40)[:100]
    assert column(tx.tree_preview, ["short", long]) == ["short", ("a b " * 40)[:60] + "..."]
    assert column(tx.html_escape, ["<a b=\"c\"> &  "]) == ["&lt;a b=\"c\"&gt; &amp; &nbsp;"]


REPLIES = [
    ('x {"synonyms": ["a", 1, "", null, "b"], "related": "x"} y', ["a", "b"], []),
    ("none", [], []), ("{bad", [], []), ('{"related": ["r"]}', [], ["r"]), ('{"a": 1} {"b": 2}', [], []),
]


def test_expansion_replies(column):
    texts = [r[0] for r in REPLIES]
    assert column(lambda c: tx.expansion_terms(c, "synonyms"), texts) == [r[1] for r in REPLIES]
    assert column(lambda c: tx.expansion_terms(c, "related"), texts) == [r[2] for r in REPLIES]
    assert [expansion.parse_reply(t) for t in texts] == [(r[1], r[2]) for r in REPLIES]


def test_format_bytes(spark):
    sizes = [0, 1, 1000, 1023, 1024, 3000, 102400, 1048576, 5 * 1024 ** 3, 2 * 1024 ** 4]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "i int, s bigint")
    got = [r[0] for r in df.orderBy("i").select(paths.format_bytes(F.col("s"))).collect()]
    assert got == ["0 B", "1.00 B", "1000.00 B", "1023.00 B", "1.00 KB", "2.93 KB", "100.00 KB", "1.00 MB", "5.00 GB",
                   "2.00 TB"]


def test_paths(column):
    names = ["file.test.ts", "noextension", ".bashrc", "a/.git", "a.b/c", "x.", "d/e.tsx"]
    assert column(paths.extension, names) == ["ts", "", "", "", "", "", "tsx"]
    assert column(paths.base_name, ["a/b\\c.ts", "c.ts", "a/"]) == ["c.ts", "c.ts", ""]
    assert column(lambda c: paths.relative_path(c, "/ws"), ["/ws/a.ts", "/wsx/a.ts", "/o"]) == ["a.ts", "/a.ts", "/o"]
    assert column(lambda c: paths.display_path(c, "/ws"), ["/ws/a.ts", "/wsx/a.ts", "/ws"]) == ["a.ts", "/wsx/a.ts", ""]


def test_exclusion_rules(column):
    globs = ("**/node_modules/**", "**/dist/**", "**/*.test.ts", "**/.git/**")
    cases = [("src/node_modules/lib.ts", True, True), ("node_modules/lib.ts", False, True),
             ("src/dist/bundle.js", True, True), ("src/file.test.ts", True, True), ("file.test.ts", False, True),
             ("a/xgit/b", True, False), ("src\\dist\\b.js", True, True), ("src/normal.ts", False, False)]
    names = [c[0] for c in cases]
    assert column(lambda c: paths.is_excluded(c, globs), names) == [c[1] for c in cases]
    assert column(lambda c: paths.is_excluded(c, globs, strict=True), names) == [c[2] for c in cases]


def test_scores(spark):
    df = spark.createDataFrame([(0.0,), (0.395,), (0.4,), (0.575,), (1.0,)], "s double")
    got = df.select(scoring.display_score(F.col("s")), scoring.low_relevance(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0, True), (40, True), (40, False), (57, False), (100, False)]


def test_token_match_ratio_equals_brute_force(spark):
    texts = ["the user record loads", "us er", "loader", "", "x.y_the", "😀"]
    query = "load user the 😀 zz"
    tokens = preparation.tokenize(query)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(scoring.token_match_ratio(tokens, F.col("t"))).collect()]
    want = []
    for t in texts:
        code = preparation.tokenize(t.lower())
        want.append(sum(any(q in c or c in q for c in code) for q in tokens) / max(len(tokens), 1))
    assert got == want


def test_progress_and_estimate(spark):
    row = spark.range(1).select(
        scoring.percentage(F.lit(1), F.lit(8)), scoring.band_percentage("chunking", F.lit(0.5)),
        scoring.band_percentage("embedding", F.lit(1.0)), scoring.processing_seconds(F.lit(33), 32)).first()
    assert tuple(row) == (13, 20.0, 80.0, 4)
