from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenseek.functions import vector as vec
from lumenseek.operators import grouping, ranking

CHUNKS = ("id string, file_path string, start_line int, end_line int, text string, type string, language string, "
          "vector array<float>")


def unit(*values):
    n = math.sqrt(sum(v * v for v in values))
    return [v / n for v in values]


@pytest.fixture
def chunks(spark):
    def run(*rows):
        full = [(i, f"/ws/{p}", 1, 2, text, kind, "ts", v) for i, p, text, kind, v in rows]
        return spark.createDataFrame(full, CHUNKS)
    return run


def test_vector_search_is_exact_and_inclusive(chunks):
    df = chunks(("a", "x.ts", "", "function", [1.0, 0.0]), ("b", "x.ts", "", "class", [0.0, 1.0]),
                ("c", "y.ts", "", "class", unit(1, 1)), ("d", "y.ts", "", "class", None), ("e", "y.ts", "", "class", []))
    got = ranking.vector_search(df, [1.0, 0.0], 10, 0.0).orderBy("rank").collect()
    assert [r.id for r in got] == ["a", "c", "b"]
    assert [r.score for r in got] == [100, 71, 0] and [r.low_relevance for r in got] == [False, False, True]
    assert got[1].distance == pytest.approx(math.sqrt(2 - math.sqrt(2)), abs=1e-6)
    exact = ranking.vector_search(df, [1.0, 0.0], 10, 1.0).collect()
    assert [r.id for r in exact] == ["a"]


def test_wide_vectors_match_plain_python(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(300)]) for i in range(20)]
    query = [rng.uniform(-1, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "i int, v array<double>").select(
        "i", "v", vec.squared_l2(F.col("v"), query).alias("d2"))
    for r in df.collect():
        total = 0.0
        for a, b in zip(r.v, query):
            total += (a - b) * (a - b)
        assert r.d2 == total


def test_fusion_of_both_lists(chunks):
    df = chunks(("a", "x.ts", "find me", "function", [1.0, 0.0]), ("b", "x.ts", "me", "class", unit(1, 1)),
                ("c", "y.ts", "find it", "class", [-1.0, 0.0]), ("d", "y.ts", "Find", "class", [0.0, -1.0]))
    got = ranking.hybrid_search(df, [1.0, 0.0], "find", 2, 0.5).orderBy("rank").collect()
    # a is in both lists; c was found by keyword too, but its distance counts.
    assert [(r.id, r.vector_rank, r.keyword_rank) for r in got] == [("a", 1, 1), ("b", 2, None)]
    assert got[0].rrf == 1 / 61 + 1 / 61


def test_keyword_only_hits_have_similarity_one(chunks):
    rows = [(f"v{i}", "x.ts", "none", "function", unit(1, i)) for i in range(4)]
    df = chunks(*rows, ("k", "y.ts", "needle", "class", [-1.0, 0.0]))
    got = {r.id: r for r in ranking.hybrid_search(df, [1.0, 0.0], "needle", 2, 0.9).collect()}
    assert got["k"].similarity == 1.0 and got["k"].score == 100 and got["k"].vector_rank is None


def test_ties_keep_vector_rows_first(chunks):
    near = [(f"z{i}", "x.ts", "none", "function", unit(9, i)) for i in range(2)]
    df = chunks(*near, ("a", "y.ts", "word", "class", [-1.0, 0.0]))
    got = ranking.hybrid_search(df, [1.0, 0.0], "word", 1, 0.0)
    fused = ranking.fuse_ranks(ranking.nearest(df, [1.0, 0.0], 2), ranking.keyword_matches(df, "word", 2))
    rows = {r.id: r.rrf for r in fused.collect()}
    assert rows == {"z0": 1 / 61, "z1": 1 / 62, "a": 1 / 61} and got.first().id == "z0"


def test_duplicate_ids_take_their_last_rank(chunks):
    row = ("a", "x.ts", "w", "function", [1.0, 0.0])
    fused = ranking.fuse_ranks(ranking.nearest(chunks(row, row), [1.0, 0.0], 4),
                               ranking.keyword_matches(chunks(row), "w", 4)).collect()
    assert [(r.id, r.vector_rank, r.keyword_rank) for r in fused] == [("a", 2, 1)]


@pytest.mark.parametrize("keyword,safe,want", [
    ("a_c", False, ["1", "2"]), ("a_c", True, ["2"]), ("a%", False, ["1", "2", "3"]), ("\\d", False, ["4"]), ("ABC", False, [])])
def test_keyword_wildcards(chunks, keyword, safe, want):
    df = chunks(("1", "x", "abc", "block", [1.0]), ("2", "x", "a_c", "block", [1.0]), ("3", "x", "ba", "block", [1.0]),
                ("4", "x", "\\d", "block", [1.0]))
    got = ranking.keyword_matches(df, keyword, 10, wildcards=not safe)
    assert [r.id for r in got.orderBy("keyword_rank").collect()] == want


def test_quote_in_keyword_falls_back_to_vectors(chunks):
    df = chunks(("a", "x.ts", "it's", "function", [-1.0, 0.0]), ("b", "x.ts", "no", "class", [1.0, 0.0]))
    assert [r.id for r in ranking.hybrid_search(df, [1.0, 0.0], "it's", 5, 0.5).collect()] == ["b"]


def test_type_filter_runs_after_the_cut(chunks):
    df = chunks(("a", "x.ts", "", "function", [1.0, 0.0]), ("b", "x.ts", "", "class", unit(3, 1)))
    top = ranking.vector_search(df, [1.0, 0.0], 1, 0.0)
    assert ranking.filter_types(top, ["class"]).count() == 0
    assert ranking.filter_types(top, []).count() == 1


def brute_rerank(rows, query):
    from lumenseek import fixed_values as fv
    from lumenseek.providers.preparation import tokenize
    q = tokenize(query.lower())

    def score(r):
        code, path = tokenize(r.text.lower()), tokenize(r.file_path.lower())
        ratio = sum(any(a in c or c in a for c in code) for a in q) / max(len(q), 1)
        hit = 1.0 if any(a in p for a in q for p in path) else 0.0
        return 0.5 * r.similarity + 0.3 * ratio + 0.1 * hit + 0.1 * fv.TYPE_BONUS.get(r.type, 0.5)

    return [r.id for r in sorted(rows, key=lambda r: -score(r))]


def test_rerank_only_reorders_and_matches_brute_force(chunks):
    rng = random.Random(3)
    words = ["load", "user", "settings", "render", "the"]
    kinds = ["function", "import", "block", "class", "odd"]
    df = chunks(*[(f"{i:02}", f"{rng.choice(words)}{i % 3}.ts", " ".join(rng.choices(words, k=4)), rng.choice(kinds),
                   unit(1, rng.random() * 3)) for i in range(30)])
    found = ranking.vector_search(df, [1.0, 0.0], 20, 0.3)
    base = found.orderBy("rank").collect()
    got = ranking.rerank(found, "loadUser the Render").orderBy("rerank_position").collect()
    assert [r.id for r in got] == brute_rerank(base, "loadUser the Render")
    assert sorted(r.id for r in got) == sorted(r.id for r in base)


def test_groups(chunks):
    df = chunks(("a", "x.ts", "one\n two", "function", [1.0, 0.0]), ("b", "y.ts", "t", "class", unit(4, 1)),
                ("c", "x.ts", "u", "class", unit(1, 1)))
    found = ranking.rerank(ranking.vector_search(df, [1.0, 0.0], 9, 0.0), "zz")
    groups = grouping.by_file(found, "/ws").collect()
    assert [(g.relative_path, g.avg_score, [c.id for c in g.chunks]) for g in groups] == [
        ("y.ts", 97.0, ["b"]), ("x.ts", 85.5, ["a", "c"])]
    tree = grouping.tree(found, "/ws", ["class"]).collect()
    assert [(g.label, g.description, g.tooltip) for g in tree] == [
        ("y.ts", "97%", "/ws/y.ts\n1 result"), ("x.ts", "71%", "/ws/x.ts\n1 result")]
    assert tuple(grouping.view_counts(found).first()) == (3, 2)


def test_many_nearest_equals_one_by_one(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(3)) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(6)
    queries = {"p": [0.0, 1.0, 2.0, 1.0], "q": [2.0, 2.0, 0.0, 0.0]}
    got = {}
    for r in ranking.many_nearest(df, queries, 7).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.d2, r.id))
    for name, q in queries.items():
        assert got[name] == sorted((sum((a - b) ** 2 for a, b in zip(v, q)), i) for i, v in rows)[:7]


def test_plan_prunes_and_limits(spark, tmp_path, chunks):
    path = str(tmp_path / "t")
    chunks(("a", "x.ts", "t", "function", [1.0, 0.0])).write.parquet(path)
    plan = ranking.vector_search(spark.read.parquet(path), [1.0, 0.0], 5, 0.1).select(
        "id", "similarity")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Join" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<id:string,vector:array<float>>" in plan
