"""Decontamination, fingerprints and token counts against plain Python and SQL."""

from __future__ import annotations

import hashlib
import struct

import duckdb
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from llm_cases import LONG, ROWS, duck, edge_documents, no_documents, words
from lumenseek.llm import decontaminate, fingerprints, tokens
from lumenseek.llm import textarrays as ta
from lumenseek.llm.common import table

SF = "/root/testdata/sf0.001"


def test_words_are_those_of_the_pattern():
    texts = [r[1] for r in ROWS] + ["a", "ab cd", "É9_x", "end ", " start"]
    found = []
    for piece in ta.pieces(pa.array(texts, pa.string()), 64):
        w = ta.Words(*ta.raw(piece))
        h = w.hashes()
        for row in range(len(piece)):
            a, b = w.first[row], w.first[row + 1]
            found.append([(w.data[s:e].tobytes().decode(), int(x)) for s, e, x in zip(w.starts[a:b], w.ends[a:b], h[a:b])])
    assert [[t for t, _ in row] for row in found] == [words(t) for t in texts]
    by_word: dict = {}
    for t, x in (p for row in found for p in row):
        assert by_word.setdefault(t, x) == x
    assert len(set(by_word.values())) == len(by_word)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Same text in FIVE"), (3, None), (4, ""),
         (5, "thing3 word3"), (None, "don't"), (2, "no id"), (6, "one")]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_decontamination_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    # The SQL copies a text's words for every window, so long texts are shorter here.
    docs = [(r[0], r[1] and r[1][:3000]) for r in ROWS] + [(20, "zero One, two three four five six seven eight nine TEN eleven one two"), (21, "one")]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    out = decontaminate.op9_decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), items)
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(map(str, db.execute(decontaminate.OP9_SQL).fetchall()))


def test_decontamination_of_long_texts(spark):
    items = spark.createDataFrame([(1, "thing3 word3"), (2, "word960 thing12 word961 thing0 word962 thing1 word963 thing2 word964 thing3 x")],
                                  "item_id bigint, text string")
    docs = spark.createDataFrame([(1, LONG), (2, LONG + " thing3 word3")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in decontaminate.op9_decontaminate(docs, items).collect()}
    found = words(LONG)
    pairs = [i for i in range(len(found) - 1) if found[i:i + 2] == ["thing3", "word3"]]
    window = words("word960 thing12 word961 thing0 word962 thing1 word963 thing2 word964 thing3")
    hit = {j for i in pairs for j in (i, i + 1)}
    hit |= {j for i in range(len(found) - 9) if found[i:i + 10] == window for j in range(i, i + 10)}
    assert rows[1].n_words == len(found) == 60_000 and rows[1].n_hit == len(hit)
    assert rows[2].n_words == len(found) + 2 and rows[2].n_hit == len(hit) + 2


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    out = decontaminate.op9_decontaminate(edge_documents(spark), none)
    assert out.count() == 15 and out.where("contaminated").count() == 0
    assert decontaminate.op9_decontaminate(no_documents(spark), table(spark, SF, "benchmark")).count() == 0


def test_matched_keeps_columns(spark):
    docs = edge_documents(spark)
    out = decontaminate.matched(docs, table(spark, SF, "benchmark"), "mark")
    assert out.columns == [*docs.columns, "mark"] and out.count() == 15


def _hash(value, seed=42):
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(raw, seed=seed & 0xFFFFFFFFFFFFFFFF).intdigest()))[0]


def _plain_codes(text: str) -> dict:
    """Hash and first word position of every anchor."""
    found = [w for w in regex.split(r"[^\p{L}\p{N}]+|(?<=[⺀-鿿])|(?=[⺀-鿿])", text, flags=regex.V1) if w]
    h = [_hash(w) for w in found]
    s = [_hash(b, _hash(a)) for a, b in zip(h, h[1:])]
    codes: dict = {}
    for i, (x, y, z) in enumerate(zip(s, s[1:], s[2:])):
        if y >= min(x, z):
            codes.setdefault((_hash(z, _hash(x)) >> 32) & 0xFFFFFFFF, i)
    return codes or {(_hash("text", _hash(text)) >> 32) & 0xFFFFFFFF: 0}


def _plain_text(codes) -> str:
    return ",".join(f"{c:08x}{i:x}" for c, i in sorted(codes.items(), key=lambda x: x[1]))


def _plain_likeness(a, b):
    runs: list[list] = []
    for x, y in sorted((a[c], b[c]) for c in a.keys() & b.keys()):
        if runs and x - y == runs[-1][3]:
            runs[-1][1:3] = y, runs[-1][2] + 1
        else:
            runs.append([y, y, 1, x - y])
    best: list = []
    for first, _, n, _ in runs:
        best.append(n + max((m for (_, last, _, _), m in zip(runs, best) if last < first), default=0))
    both = max(best, default=0)
    return both / (len(a) + len(b) - both)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("rows", [512, 3])
def test_fingerprints_equal_plain_ones(spark, monkeypatch, no_broadcast, rows):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", rows)
    docs = edge_documents(spark).union(edge_documents(spark).where("doc_id > 3").selectExpr(
        "doc_id + 100", "concat(text, ' more words at the end')", "lang", "source", "n_chars", "score", "key", "found"))
    plain = sorted(((r.doc_id, r.text or "") for r in docs.collect()),
                   key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), _hash(r[1])))
    expected = []
    for (doc_id, text), (_, after) in zip(plain, plain[1:] + plain[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, e, n = _plain_codes(text), _plain_codes(edited), _plain_codes(after)
        expected.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), _plain_text(a),
                         _plain_text(e), _plain_likeness(a, e), _plain_likeness(a, n)))
    got = [tuple(r) for r in fingerprints.op7_fingerprints(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_fingerprints_of_long_texts_are_whole(spark):
    passage = [f"p{i}" for i in range(50)]
    texts = [" ".join([f"{c}{i}" for i in range(2500)] + passage + [f"{c}{i}" for i in range(2500, 5000)]) for c in "ab"]
    rows = fingerprints.op7_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    shared = set(_plain_codes(" ".join(passage)))
    for r in rows:
        found = {int(x[:8], 16) for x in r.fingerprint.split(",")}
        assert len(found) > 3000 and shared <= found
        assert r.near_next >= len(shared) / (2 * len(found))


def test_fingerprints_of_little(spark):
    assert fingerprints.op7_fingerprints(no_documents(spark)).count() == 0
    one = fingerprints.op7_fingerprints(edge_documents(spark).where("doc_id = 4")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_anchors_move_with_the_text(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(passage,), ("x y z " + passage,)], "text string").select(
        fingerprints.anchors(F.col("text")).alias("a")).collect()
    first, second = ({(a.position + d, a.code) for a in r.a} for r, d in zip(rows, (3, 0)))
    assert first <= second


def test_likeness_follows_the_order_of_passages(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(400)) for c in "xyz")
    whole = f"{one} {two} {three}"
    others = [whole, f"{one} some words more {two} {three}", f"{two} {three} {one}", f"{three} {two} {one}", f"{one} {three}", "nothing in common at all here",
              " ".join(w for i, w in enumerate(whole.split()) if i % 50), f"{one} {one} {two} {two} {three}"]
    rows = spark.createDataFrame([(i, whole, o) for i, o in enumerate(others)], "i int, a string, b string")
    got = [r[0] for r in rows.orderBy("i").select(fingerprints.likeness(fingerprints.placed(F.col("a")), fingerprints.placed(F.col("b")))).collect()]
    assert got == [_plain_likeness(_plain_codes(whole), _plain_codes(o)) for o in others]
    assert got[0] == 1 and got[1] > 0.97 and 0.45 < got[2] < 0.55 and 0.18 < got[3] < 0.25 and 0.6 < got[4] < 0.7 and got[5] == 0
    assert 0.7 < got[6] < 1 and got[7] > 0.95


def test_fingerprint_plan_has_no_python(spark):
    plan = fingerprints.op7_fingerprints(table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def _library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_token_counts_equal_the_library(spark):
    path, library = _library()
    docs = edge_documents(spark).select("doc_id", "text").union(table(spark, SF, "documents").select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([(500, "<|STARTOFTEXT|> <|startoftext|>x<|endoftext|>"), (501, "i̇İ ǅ ŉ 'LL we'Ve")],
                                            "doc_id bigint, text string"))
    texts = docs.collect()
    expected = [(r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 2048)
                for r in texts]
    got = [tuple(r) for r in tokens.op8_tokens(spark, docs, path).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert tokens.op8_tokens(spark, no_documents(spark), path).count() == 0


def test_plain_characters_are_cut_like_the_library():
    path, library = _library()
    with open(path, encoding="utf-8") as f:
        counter = tokens.Counter(f.read(), {})
    for c in map(chr, range(0x260)):
        for text in (c, f"a{c}b", f"A{c}{c} {c}1 {c}'{c}s don{c}t"):
            assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_worker_cache_is_bounded(monkeypatch):
    path, _ = _library()
    monkeypatch.setattr(tokens, "CACHE", 3)
    with open(path, encoding="utf-8") as f:
        counter = tokens.Counter(f.read(), {"the": 1})
    assert counter("the cat sat on a mat by a lake") == 9 and len(counter.lengths) == 4
    assert LONG


def test_every_script_is_looked_up():
    path, library = _library()
    with open(path, encoding="utf-8") as f:
        counter = tokens.Counter(f.read(), {})
    library.encode_special_tokens = False
    texts = ["\u201cCurly\u201d quotes \u2014 and dashes\u2026 it\u2019s", "Москва и ΣΊΣΥΦΟΣ Σ", "日本語の文章です。 漢字 ABC", "emoji \U0001f600\U0001f600 x\u200dy", "İı ﬁ Å Å ｆｕｌｌ",
             "عربي ١٢٣", "हिन्दी १२", "a\u00a0b\u2003c\u0085d"]
    for text in texts * 2:
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), text
        assert counter.pre_tokens(text) is not None
    assert len(counter.wide) > 20
    known = dict(counter.wide)
    counter.wide.encode = None  # everything is known by now
    for text in texts:
        counter(text)
    assert dict(counter.wide) == known


def test_sample_is_not_sent_to_one_task(spark):
    path, _ = _library()
    docs = table(spark, SF, "documents")
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    found = tokens.frequent_lengths(docs, definition, spark.sparkContext.broadcast({}))
    assert len(found) > 100 and found == tokens.frequent_lengths(docs.repartition(7), definition, spark.sparkContext.broadcast({}))
