"""Mixing, sharding, near-duplicates, revisits and the pipeline."""

from __future__ import annotations

import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_cases import ROWS, duck, edge_documents, edge_labels, no_documents, words
from lumenseek.llm import mixing, near_dedup, queries, revisits, sharding
from lumenseek.llm.common import table

SF = "/root/testdata/sf0.001"


# -- mixing ---------------------------------------------------------------------------------------
def test_expected_totals_meet_the_targets(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    for weights, least in (({"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, 0.0), (None, 1.0), ({"en": 0.0, "de": 1.0}, 0.0)):
        members, domains, steps, targets = mixing.fitted(docs, labelled, weights, least)
        rows = members.withColumn("r", mixing._rate(F.col("posterior"), steps, least)).collect()
        assert min(r.r for r in rows) >= least
        for c, d in enumerate(domains.names):
            total = sum(r.r * r.n_tokens * r.posterior[c] for r in rows)
            assert total == pytest.approx(targets[d], abs=0.01 * max(targets.values()))


def test_mixing_finds_the_language(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.op1_mixing(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.domain for r in rows) >= 0.95 * len(rows)
    assert all(abs(r.copies - r.rate) < 1 and r.copies >= 1 for r in rows)
    assert sum(r.copies for r in rows) == pytest.approx(sum(r.rate for r in rows), rel=0.05)


def test_mixing_edge_rows(spark):
    docs = edge_documents(spark)
    rows = mixing.op1_mixing(docs).collect()
    assert len(rows) == 15 and all(r.copies >= 1 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3, 5)} == {0}
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    out = mixing.repeated(docs, labelled)
    copies = Counter(str(r) for r in out.collect())
    assert out.columns == docs.columns and set(copies) == {str(r) for r in docs.collect()}
    dropped = mixing.repeated(docs, labelled, {"en": 1.0}, least=0.0)
    assert dropped.columns == docs.columns
    assert mixing.repeated(no_documents(spark), labelled.limit(0)).count() == 0
    assert mixing.op1_mixing(docs.withColumn("lang", F.lit(None).cast("string"))).where("rate <> 1 or domain <> 'none'").count() == 0


def test_mixing_plan_has_no_python(spark):
    plan = mixing.op1_mixing(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- sharding -------------------------------------------------------------------------------------
@pytest.mark.parametrize("bucket", [4096, 3])
def test_shards_equal_a_plain_interleaving(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    docs = edge_documents(spark).union(table(spark, SF, "documents").selectExpr(
        "doc_id + 1000", "text", "lang", "if(doc_id % 3 = 0, 'hot', source)", "n_chars", "null", "null", "null"))
    hashed = docs.select("doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"),
                         F.crc32(F.coalesce("text", F.lit(""))).alias("crc"))
    hashed = hashed.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(0), "doc_id", "crc"), 1)).collect()
    by = defaultdict(list)
    for r in hashed:
        by["n" if r.source is None else "s" + r.source].append((r.h, r.doc_id if r.doc_id is not None else -(1 << 63), r.size, r.crc))
    line = []
    for stratum, rows in by.items():
        for rank, row in enumerate(sorted(rows)):
            line.append(((2 * rank + 1) / (2 * len(rows)), stratum, rank, row[1:]))
    line.sort()
    n, expected, slots = len(line), [], Counter()
    for place, (_, _, _, row) in enumerate(line):
        shard = place * 8 // n
        expected.append((*row, shard, slots[shard]))
        slots[shard] += 1
    got = [(r.doc_id if r.doc_id is not None else -(1 << 63), r.size, r.text_crc32, r.shard, r.slot) for r in sharding.manifest(docs).collect()]
    assert sorted(got) == sorted(expected)
    assert max(slots.values()) - min(slots.values()) <= 1


def test_shards_of_little(spark):
    assert sharding.manifest(no_documents(spark)).count() == 0
    rows = sharding.manifest(edge_documents(spark).limit(3)).collect()
    assert len(rows) == 3 and {r.slot for r in rows} == {0}


def test_one_row_that_repeats(spark):
    docs = spark.range(500).selectExpr("1L as doc_id", "'same' as text", "'a' as source")
    rows = sharding.manifest(docs).collect()
    assert Counter(r.shard for r in rows) == {k: (63 if k % 2 == 0 else 62) for k in range(8)}


def test_shards_are_written(spark, tmp_path):
    docs = table(spark, SF, "documents")
    sharding.write_shards(docs, f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.select("shard").distinct().count() == 8
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


# -- near duplicates ------------------------------------------------------------------------------
def _labelled(ws):
    size, seen, out = min(5, len(ws)), Counter(), []
    for i in range(len(ws) - size + 1 if ws else 0):
        s = tuple(ws[i:i + size])
        out.append((s, seen[s]))
        seen[s] += 1
    return out


def _alignment(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def _plain_classes(rows):
    """Class (smallest id) of each (doc_id, text) by all pairs that share a shingle."""
    shingles = {i: _labelled(words(t)) for i, t in rows}
    sets = {i: set(s) for i, s in shingles.items()}
    parent = {i: i for i in shingles}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(shingles)
    for at, i in enumerate(ids):
        for j in ids[:at]:
            a, b = shingles[i], shingles[j]
            common = len(sets[i] & sets[j])
            if a and b and common >= 0.8 * (len(a) + len(b) - common):
                m = len(a) if a == b else _alignment(a, b)
                if m >= 0.8 * (len(a) + len(b) - m):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _near_copies():
    rng = random.Random(3)
    out = []
    for base in range(4):
        text = [f"w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            out.append((len(out) + 1, " ".join(copy)))
    return out


def test_classes_equal_those_of_all_pairs(spark):
    rows = _near_copies() + [(1000 + r.doc_id, r.text) for r in table(spark, SF, "documents").where("length(text) < 4000").collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.with_classes(docs).collect()}
    assert got == _plain_classes(rows)
    kept = near_dedup.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def _around_a_passage():
    """Three lots of texts that share most of a long passage and are too different to be near, but for one pair of each lot."""
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.randrange(10 ** 8)}" for _ in range(n)]
    texts = []
    for _ in range(3):
        passage = fresh(100)
        texts += [passage + fresh(n) for n in [38] * 250 + [10, 10]]
    rng.shuffle(texts)
    return [(i + 1, " ".join(t)) for i, t in enumerate(texts)]


def test_near_pairs_in_crowded_entries(spark):
    rows = _around_a_passage()
    got = {r.doc_id: r.class_id for r in near_dedup.with_classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = _plain_classes(rows)
    assert got == want and len(rows) - len(set(want.values())) == 3


def test_near_short_texts_share_an_entry():
    import numpy as np
    random_codes = np.random.RandomState(0)
    for _ in range(2000):
        codes = random_codes.randint(0, 2 ** 62, 5).astype(np.uint64)
        assert set(near_dedup.sketch(codes).tolist()) & set(near_dedup.sketch(codes[:4]).tolist())


def test_exhaustive_search_finds_all(spark):
    rows = _near_copies()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    heads = near_dedup.near_classes(docs, exhaustive=True).select("head.doc").distinct().count()
    assert heads == len(set(_plain_classes(rows).values()))


def test_near_edge_rows(spark):
    docs = edge_documents(spark)
    rows = near_dedup.with_classes(docs).collect()
    assert len(rows) == 15
    same = {r.doc_id: r.class_id for r in rows}
    assert same[11] == 10 and same[7] == 6 and same[1] == 1 and same[12] == 12 and same[2] == 2
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(10) == 1 and 11 not in ids and 7 not in ids and {1, 12, 2, 3, 5, None} <= set(ids)
    assert near_dedup.with_classes(no_documents(spark)).count() == 0 and near_dedup.one_of_each(no_documents(spark)).count() == 0


def test_similarity_is_the_best_alignment():
    import numpy as np
    rng = random.Random(1)
    for _ in range(200):
        a = rng.sample(range(60), rng.randrange(1, 40))
        b = [x for x in a if rng.random() > 0.05]
        if rng.random() < 0.5 and len(b) > 3:
            i = rng.randrange(len(b) - 1)
            b[i], b[i + 1] = b[i + 1], b[i]
        b = b or [99]
        m = _alignment(a, b)
        exact = m / (len(a) + len(b) - m)
        got = near_dedup.similarity(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64))
        assert got == pytest.approx(exact if exact >= 0.8 else 0.0)


# -- revisits -------------------------------------------------------------------------------------
def test_revisits_equal_sql(spark):
    got = revisits.op6_revisits(table(spark, SF, "pages"))
    want = duck(SF).execute(f"SELECT {', '.join(got.columns)} FROM ({revisits.OP6_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("size", [4096, 4])
def test_as_of_join_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(revisits, "RANGE_ROWS", size)
    rng = random.Random(5)
    rows = []
    for i in range(300):
        url = rng.choice(["http://hot.example/", "https://www.HOT.example", "http://b.example/x?ref=1&b=2&a=1", None])
        kind = rng.choice(["response", "revisit"])
        rows.append((i, kind, url, rng.choice([None, *range(60)]), rng.choice([200, 200, 404]) if kind == "response" else 304,
                     rng.choice([None, {"etag": f'"{rng.randrange(3)}"', "date": str(i), "x-own": "1"}, {"last-modified": "d"}]), f"p{i}"))
    df = spark.createDataFrame(rows, "record_id bigint, kind string, url string, at bigint, status int, headers map<string,string>, digest string")
    got = {r.record_id: r for r in revisits.resolve(df).collect()}
    key = {"http://hot.example/": "h", "https://www.HOT.example": "h", "http://b.example/x?ref=1&b=2&a=1": "b"}
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    for i, kind, url, at, _, headers, _ in rows:
        if kind != "revisit":
            continue
        base = max(((r[3], r[0], r) for r in rows if r[1] == "response" and r[4] == 200 and r[3] is not None and at is not None
                    and url and key.get(r[2]) == key[url] and r[3] < at), default=None)
        r, mine, stored = got[i], headers or {}, (base[2][5] or {}) if base else {}
        assert r.base_id == (base[1] if base else None)
        if not base:
            assert r.verdict == "no_response"
        elif "etag" in mine and "etag" in stored:
            assert r.verdict == ("resolved" if mine["etag"] == stored["etag"] else "stale")
        else:
            assert r.verdict == ("resolved" if "last-modified" in mine and "last-modified" in stored else "unvalidated")
        if r.verdict == "resolved":
            assert r.digest == base[2][6]
            assert r.headers == {**stored, **{k: v for k, v in mine.items() if k in revisits.PERMITTED}}
    assert revisits.resolve(df.limit(0)).count() == 0


FIRST = """
import sys
from lumenseek.llm import queries, revisits
from lumenseek.session import build_session

spark = build_session("first", "local[2]", **{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
                                              "spark.sql.autoBroadcastJoinThreshold": "-1"})
revisits.RANGE_ROWS = 4
queries.QUERIES["op6_revisits"](spark, sys.argv[1]).write.parquet(sys.argv[2])
"""


def test_revisits_as_first_query_of_a_session(spark, tmp_path):
    """The columns then have numbers as small as those by which Spark compares lambda variables."""
    rng, sf, out = random.Random(6), tmp_path / "sf", tmp_path / "out"
    rows = [(i, f"{rng.choice(['http://a', 'https://m.b', 'http://www.c'])}.example/{rng.randrange(4)}{rng.choice(['', '.html', '#top', '/'])}",
             f"<p>{rng.randrange(3)}</p>") for i in range(60)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"file://{sf}/pages.parquet")
    subprocess.run([sys.executable, "-c", FIRST, f"file://{sf}", f"file://{out}"], cwd=os.path.dirname(corpus_pipeline.__file__),
                   check=True, timeout=300)
    got = spark.read.parquet(f"file://{out}")
    want = duck(str(sf)).execute(f"SELECT {', '.join(got.columns)} FROM ({revisits.OP6_SQL})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r[3] for r in want} == {"resolved", "stale", "unvalidated", "no_response"}


def test_canonical_urls(column):
    urls = ["HTTPS://WWW.Example.com:443/A/?utm_source=x&b=2&a=1#f", "http://example.com/A?a=1&b=2", " example.com/A/ ", ""]
    assert column(revisits.canonical, urls) == ["example.com/A?a=1&b=2", "example.com/A?a=1&b=2", "example.com/A", ""]


# -- pipeline and registration --------------------------------------------------------------------
CLASHING = ["__same", "__doc", "__head", "__copies", "__copy", "label", "head", "body", "size", "copy", "stratum", "posterior", "kept"]


def test_stages_on_edge_rows(spark, tmp_path):
    clashing = edge_documents(spark).select("*", *[F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in CLASHING])
    for start in (clashing, no_documents(spark)):
        docs = start
        for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            assert out.columns == start.columns + (["shard", "slot"] if name == "sharding" else [])
            path = f"file://{tmp_path}/{start.count()}-{at}"
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            known = {str(tuple(r)) for r in start.collect()}
            assert {str(tuple(r)[:len(start.columns)]) for r in docs.collect()} <= known


def test_sharded_rows_are_the_rows_that_came_in(spark):
    docs = edge_documents(spark).union(edge_documents(spark).selectExpr(
        "doc_id", "text", "'other' lang", "source", "n_chars", "score", "key", "found")).union(edge_documents(spark)).withColumn("slot", F.lit("x"))
    out = sharding.sharded(docs).collect()
    plain = [c for c in docs.columns if c != "slot"]
    assert Counter(str([r[c] for c in plain]) for r in out) == Counter(str([r[c] for c in plain]) for r in docs.collect())
    assert sorted((r.shard, r.slot) for r in out) == sorted((r.shard, r.slot) for r in sharding.manifest(docs).collect())


def test_pipeline_keeps_clean_documents(spark):
    docs, kept = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, docs = docs, stage(spark, docs, SF)
        kept[name] = ({r.doc_id for r in before.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()})
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert good & kept["quality"][0] <= kept["quality"][1]
    leaks = {r[0] for r in duck(SF).execute(f"SELECT doc_id FROM ({queries.ORACLES['op9_decontaminate']}) WHERE contaminated").fetchall()}
    assert kept["decontaminate"][0] - leaks == kept["decontaminate"][1]
    assert kept["mixing"][0] == kept["mixing"][1]


def test_every_operator_is_registered():
    assert {int(name[2:].split("_")[0]) for name in queries.QUERIES} == set(range(1, 14))
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mixing", "sharding"]
    assert edge_labels and ROWS and duckdb
