"""Spelling variants against comparison of all words with all."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm_cases import edge_documents, no_documents
from lumenseek.llm import variants
from lumenseek.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_counts(rows):
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(x, y):
    """Whether one insertion, deletion or replacement makes y of x."""
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    start = 0
    while start < min(len(x), len(y)) and x[start] == y[start]:
        start += 1
    return x[start + (len(x) >= len(y)):] == y[start + (len(y) >= len(x)):]


def brute_force(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top is not None and counts[top] >= 10 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def test_equals_comparison_of_all_words(spark):
    docs = table(spark, SF, "documents")
    counts = brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert len(counts) > 1000
    assert sorted(map(tuple, variants.op12_variants(docs).collect())) == brute_force(counts)


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcé", 2), ("a", 3)])
def test_few_letters_lose_no_pair(spark, letters, seed):
    """Repeated bigrams and equal frequencies everywhere; with one letter all bigrams tie."""
    rng = random.Random(seed)
    known = {"".join(rng.choices(letters, k=rng.randint(7, 10))): rng.randint(2, 500) for _ in range(400)}
    rows = spark.createDataFrame(list(known.items()), "word string, n bigint")
    found = {(r.x, r.y) for r in variants.near_pairs(rows).collect()}
    assert found == {(x, y) for x in known for y in known if x < y and one_edit(x, y)}
    got = variants.forms(rows)
    roots = {r.word: r.root for r in variants.roots(got).collect()}
    plain = {w: (f, root) for w, f, root, *_ in brute_force(known)}
    assert {r.word: (r.form, roots.get(r.word, r.word)) for r in got.collect()} == plain


def test_chain_of_forms_leads_to_its_end(spark):
    known = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("zzzzzzz", 5)]
    got = variants.forms(spark.createDataFrame(known, "word string, n bigint"))
    assert {r.word: r.root for r in variants.roots(got).collect()} == {w: "aaabbbb" for w, n in known[:4]}


def test_pivots_cost_least():
    rng = random.Random(5)
    for _ in range(300):
        cost = [rng.randint(1, 9) for _ in range(12)]
        ranks = [rng.randrange(12) for _ in range(rng.randint(6, 14))]
        last = sorted(ranks)[2]
        prefix = [i for i, r in enumerate(ranks) if r <= last]
        a, b = variants.pivots(ranks, cost, prefix)
        assert b - a >= 2 and cost[ranks[a]] + cost[ranks[b]] == min(
            cost[ranks[i]] + cost[ranks[j]] for i in prefix for j in prefix if j - i >= 2)


def test_edge_rows_and_an_empty_table(spark):
    docs = edge_documents(spark).unionByName(spark.createDataFrame(
        [(None, "Wordword WORDWORD wordworÀà wordword"), (3, "wordwords " * 30 + "wordword")], "doc_id bigint, text string"),
        allowMissingColumns=True).withColumn("word", F.lit("x")).withColumn("n", F.lit("y"))
    counts = brute_counts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    out = variants.op12_variants(docs)
    assert out.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted(map(tuple, out.collect())) == brute_force(counts)
    assert variants.op12_variants(no_documents(spark)).count() == 0

