"""Cross-tokenizer alignment against plain loops over whole encodings."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from llm_cases import ROWS, edge_documents, no_documents
from lumenseek.llm import alignment
from lumenseek.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def ends(parts):
    return np.cumsum([len(p) for p in parts]).tolist()


def brute_force(rows):
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()
    name = {i: p for p, i in a.get_vocab().items()}
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a, bytes_b = [bytes(alphabet[c] for c in name[i]) for i in ids_a], [spell_b(i) for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc_id, 0, 0, [], ""))
            continue
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
        links, groups, done_a, done_b = [], [], 0, 0
        for e in ends_a:
            if e in at_b:
                i, j = at_a[e] + 1, at_b[e] + 1
                groups.append(",".join(map(str, ids_a[done_a:i])) + "|" + ",".join(map(str, ids_b[done_b:j])))
                links.append((ids_a[i - 1], ids_b[j - 1]))
                done_a, done_b = i, j
        counts.update(links)
        found.append((doc_id, len(ids_a), len(ids_b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best: dict = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, n, m, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), sha)
            for d, n, m, x, sha in found]


def test_successor_doubling_finds_the_groups():
    rng = np.random.default_rng(7)
    for length in (1, 2, 50, 1000):
        total = length * 2
        for share in (0.02, 0.5, 0.95):
            cut_a, cut_b = (np.union1d(np.flatnonzero(rng.random(total) < share) + 1, [total]) for _ in "ab")
            last_a, last_b = alignment.last_of_group(cut_a, cut_b)
            shared = np.intersect1d(cut_a, cut_b)
            assert (cut_b[last_a] == shared[np.searchsorted(shared, cut_a)]).all()
            assert (cut_b[last_b] == shared[np.searchsorted(shared, cut_b)]).all()


def test_segments_spell_the_text_and_encode_alone():
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    assert aligner.by_segment
    texts = ["a  b", "  ", "\n\n x\t y \n", "don't  stop  now \x1c z", "x   y", "日本 語 ▁ z", "<s> <0x41> <|endoftext|> ", " a", "\x00 \x85  b"]
    for text in texts + [r[1] for r in ROWS if r[1] and len(r[1]) < 1000]:
        codes = aligner.texts([text])[0]
        whole = brute_force([(1, text)])[0]
        assert (int(aligner.n_a.all()[codes].sum()), int(aligner.n_b.all()[codes].sum())) == whole[1:3], text
        assert (hashlib.sha256(aligner.groups(codes)).hexdigest() if len(codes) else "") == whole[-1], text


def test_blocks_do_not_change_results_when_the_cache_restarts(monkeypatch):
    aligner = alignment.Aligner(open(A, encoding="utf-8").read(), open(B, "rb").read())
    texts = [f"some words {i} and odd{i}x ones" for i in range(40)]
    before = [aligner.block([i], [t])["sha"] for i, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "CACHE", 10)
    assert [aligner.block([i], [t])["sha"] for i, t in enumerate(texts)] == before


@pytest.mark.parametrize("source", ["edge", "table", "empty"])
def test_alignment_equals_brute_force(spark, source):
    docs = {"edge": lambda: edge_documents(spark), "empty": lambda: no_documents(spark),
            "table": lambda: table(spark, SF, "documents").repartition(5)}[source]()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    out = alignment.op13_alignment(spark, docs.withColumn("pair", docs.text).withColumn("block", docs.text), A, B)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute_force(rows), key=key)
