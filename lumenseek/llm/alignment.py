"""Alignment of two tokenizers: groups of tokens that cover the same bytes, and links between the tokens that end them.

The tokens of a text under both tokenizers are the nodes of an overlap graph;
its components are the groups. Every token points to its farthest-right
overlapping token, and doubling of the successors (``next = next[next]``, for
all tokens of a batch at once) brings every token to the last one of its
component, whose place names the group.

Both vocabularies here cut at every space that follows something else, so a
text is the sequence of its space-led segments; a worker encodes and aligns a
segment once and keeps it. A text of which a segment fails the byte test is
tried as a whole. Tokenizers without that property see whole texts only.

Counts over the corpus take two shuffles of small rows: a block of documents
(one Arrow batch at most) asks for every pair of token ids it holds once,
however often and in however many of its documents it occurs, and gets the
pair's count back. A very frequent pair thus has one row per block.

Defined results. Null and empty texts, and texts whose tokens do not spell the
text (a literal U+2581, for one), have no tokens: zeros and an empty digest. A
null id is kept, repeated rows count as often as they stand there, other
columns are not read, an empty table gives no rows. Equal counts are all best.
A very long text is one block; its arrays are about four times its bytes.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumenseek.llm.common import ready, staged

#: Segments a worker keeps, and their characters; beyond, it starts anew.
CACHE, CACHE_CHARS = 200_000, 1 << 24
#: Characters of text in a block of several documents.
BLOCK_CHARS = 1 << 21
_SHIFT = 32

#: A piece of text from a space that follows something else up to the next such space.
_segments = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+").findall

BLOCKS = ("block string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_links array<bigint>, "
          "sha array<string>, sizes array<int>, doc_pairs array<int>, doc_times array<int>, pairs array<bigint>, "
          "pair_n array<bigint>")
RESULT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
          "groups_sha256 string")


def last_of_group(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every token of A and of B, the number of the B token that ends its group.

    ``end_a`` and ``end_b`` are the rising byte ends of the tokens of one or
    more texts laid end to end; both cover the same bytes.
    """
    n_a, n_b = len(end_a), len(end_b)
    # The farthest-right overlapping token is the first of the other side that ends no earlier.
    of_a = n_a + np.searchsorted(end_b, end_a)
    over = np.searchsorted(end_a, end_b)
    of_b = np.where(end_a[over] > end_b, over, n_a + np.arange(n_b)) if n_a else np.zeros(0, np.int64)
    following = np.concatenate([of_a, of_b])
    while True:
        farther = following[following]
        if np.array_equal(farther, following):
            return following[:n_a] - n_a, following[n_a:] - n_a
        following = farther


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + at): b for at, b in enumerate(hidden)}}


class Growing:
    """A numpy array that is appended to."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def append(self, values) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[:self.size], np.zeros(max(need, 2 * len(self.data)) - self.size, self.data.dtype)])
        self.data[self.size:need] = values
        self.size = need

    def all(self) -> np.ndarray:
        return self.data[:self.size]


class Codes(dict):
    """Numbers of segments; new ones wait in ``fresh`` to be aligned."""

    def __init__(self):
        super().__init__()
        self.fresh, self.next, self.chars = [], 0, 0

    def __missing__(self, segment: str) -> int:
        self[segment] = code = self.number(segment)
        return code

    def number(self, segment: str) -> int:
        self.fresh.append(segment)
        self.chars += len(segment)
        self.next += 1
        return self.next - 1


class Aligner:
    """Encodes and aligns segments; made once per worker."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_str(definition)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for piece, at in self.a.get_vocab().items():
            # Added tokens are no byte-level strings; they are never produced here.
            self.bytes_a[at] = bytes(map(alphabet.__getitem__, piece)) if all(c in alphabet for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.by_segment = self._cuts_at_spaces(json.loads(definition), pieces)
        self.restart()

    @staticmethod
    def _cuts_at_spaces(definition: dict, pieces: list[str]) -> bool:
        cutter = definition.get("pre_tokenizer") or {}
        return (definition.get("normalizer") is None and cutter.get("type") == "ByteLevel" and bool(cutter.get("use_regex"))
                and not cutter.get("add_prefix_space") and all(t["special"] for t in definition.get("added_tokens", []))
                and not any(regex.search("[^▁]▁", p) for p in pieces))

    def restart(self) -> None:
        self.codes = Codes()
        self.good, self.n_a, self.n_b = Growing(bool), Growing(np.int64), Growing(np.int64)
        self.links, self.link_from, self.n_links = Growing(np.int64), Growing(np.int64), Growing(np.int64)
        self.text: list[bytes] = []

    def learn(self) -> None:
        """Align the segments that wait."""
        fresh, self.codes.fresh = self.codes.fresh, []
        if not fresh:
            return
        ids_a = [e.ids for e in self.a.encode_batch_fast(fresh, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in fresh], num_threads=1)
        good = []
        for at, segment in enumerate(fresh):
            spelled = segment.encode("utf-8", "surrogatepass")
            good.append(b"".join(map(self.bytes_a.__getitem__, ids_a[at])) == spelled
                        and b"".join(map(self.bytes_b.__getitem__, ids_b[at])) == spelled)
            if not good[-1]:
                ids_a[at], ids_b[at] = [], []
        n_a, n_b = np.array(list(map(len, ids_a)), np.int64), np.array(list(map(len, ids_b)), np.int64)
        flat_a = np.fromiter((i for ids in ids_a for i in ids), np.int64, int(n_a.sum()))
        flat_b = np.fromiter((i for ids in ids_b for i in ids), np.int64, int(n_b.sum()))
        last_a, last_b = last_of_group(np.cumsum(self.len_a[flat_a]), np.cumsum(self.len_b[flat_b]))
        ends_a = np.flatnonzero(np.diff(last_a, append=-1))  # last A token of every group
        ends_b = np.flatnonzero(np.diff(last_b, append=-1))
        of_segment = np.searchsorted(np.cumsum(n_a), ends_a, side="right")
        n_links = np.bincount(of_segment, minlength=len(fresh)) if len(ends_a) else np.zeros(len(fresh), np.int64)
        self.good.append(good)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.link_from.append(self.links.size + np.cumsum(n_links) - n_links)
        self.n_links.append(n_links)
        self.links.append((flat_a[ends_a] << _SHIFT) | flat_b[ends_b])
        said_a, said_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, a, b = [], 0, 0
        for to_a, to_b in zip((ends_a + 1).tolist(), (ends_b + 1).tolist()):
            groups.append(",".join(said_a[a:to_a]) + "|" + ",".join(said_b[b:to_b]))
            a, b = to_a, to_b
        done = 0
        for n in n_links.tolist():
            self.text.append(";".join(groups[done:done + n]).encode())
            done += n

    def numbered(self, text: str | None) -> np.ndarray:
        """The numbers of a text's segments; ``learn`` must follow."""
        if not text:
            return np.zeros(0, np.int64)
        spaced = " " + text
        if not self.by_segment:
            return np.array([self.codes.number(spaced)])
        found = _segments(spaced)
        return np.fromiter(map(self.codes.__getitem__, found), np.int64, len(found))

    def texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """Segment numbers of every text; none where its tokens do not spell it."""
        out = [self.numbered(t) for t in texts]
        self.learn()
        for at, codes in enumerate(out):
            if not self.good.all()[codes].all():
                whole = np.array([self.codes.number(" " + texts[at])])
                self.learn()
                out[at] = whole if self.good.all()[whole[0]] else whole[:0]
        return out

    def groups(self, codes: np.ndarray) -> bytes:
        return b";".join(map(self.text.__getitem__, codes.tolist()))

    def block(self, doc_ids: list, texts: list[str | None]) -> dict:
        """What a block of documents holds, with its pairs of ids numbered from 0."""
        if self.codes.next > CACHE or self.codes.chars > CACHE_CHARS:
            self.restart()
        of_doc = self.texts(texts)
        sizes = np.array(list(map(len, of_doc)), np.int64)
        codes = np.concatenate(of_doc)
        per_doc = [_sums(x.all()[codes], sizes) for x in (self.n_a, self.n_b, self.n_links)]
        n, start = self.n_links.all()[codes], self.link_from.all()[codes]
        flat = self.links.all()[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        pairs, of_link = np.unique(flat, return_inverse=True)
        # The distinct pairs of each document and how often it has them.
        held, times = np.unique(np.repeat(np.arange(len(texts)), per_doc[2]) * len(pairs) + of_link, return_counts=True)
        doc, pair = np.divmod(held, max(len(pairs), 1))
        sha = [hashlib.sha256(self.groups(x)).hexdigest() if len(x) else "" for x in of_doc]
        return {"block": uuid.uuid4().hex, "doc_id": doc_ids, "n_a": per_doc[0], "n_b": per_doc[1], "n_links": per_doc[2],
                "sha": sha, "sizes": np.bincount(doc, minlength=len(texts)), "doc_pairs": pair, "doc_times": times,
                "pairs": pairs, "pair_n": np.bincount(of_link, minlength=len(pairs))}


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values``."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return total[ends] - total[ends - sizes]


_aligners: dict = {}


def _aligner(key: str, definition, model) -> Aligner:
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(definition.value, model.value)
    return _aligners[key]


_TYPES = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_links": pa.int64(), "sha": pa.string(),
          "sizes": pa.int32(), "doc_pairs": pa.int32(), "doc_times": pa.int32(), "pairs": pa.int64(), "pair_n": pa.int64()}


def aligned_blocks(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per block of documents: the figures and distinct pairs of each, and those of all."""
    ready(spark)
    with open(path_a, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    with open(path_b, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex

    def encode(batches):
        aligner = _aligner(key, definition, model)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            start = size = 0
            for at, text in enumerate(texts + [None]):
                if at > start and (at == len(texts) or size + len(text or "") > BLOCK_CHARS):
                    found = aligner.block(ids[start:at], texts[start:at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([found["block"]])] + [pa.array([found[k]], pa.list_(t)) for k, t in _TYPES.items()],
                        ["block", *_TYPES])
                    start, size = at, 0
                size += len(text or "")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, BLOCKS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair``, ``total`` links of it, and whether that is the ``best`` of its B id.

    The window holds one row per A id that a B id was linked to, so the
    vocabulary bounds it.
    """
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def _answered(batches):
    for batch in batches:
        for row in range(len(batch)):
            x = {name: batch.column(name)[row].values for name in batch.schema.names if name != "block"}
            get = lambda k: x[k].to_numpy(zero_copy_only=False) if x[k] is not None else np.zeros(0, np.int64)
            pairs, times, sizes = get("doc_pairs"), get("doc_times").astype(np.int64), get("sizes").astype(np.int64)
            out = [_sums(get(k).astype(np.int64)[pairs] * times, sizes) for k in ("best", "total")]
            yield pa.RecordBatch.from_arrays(
                [x["doc_id"], x["n_a"], x["n_b"], x["n_links"], x["n_links"], pa.array(out[0]), pa.array(out[1]), x["sha"]],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def op13_alignment(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Tokens, groups and links of every document, and how its links rank in the whole corpus.

    A null or empty text, or one that either tokenizer does not spell, gives
    zeros and an empty digest; see the module for the other cases.
    """
    blocks = staged(aligned_blocks(spark, docs, path_a, path_b), "op13-blocks")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_n")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.pair_n").alias("n"))
    answers = asked.join(pair_counts(asked), "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("a"))
    answers = answers.select("block", F.col("a.total").alias("total"), F.col("a.best").cast("array<int>").alias("best"))
    return blocks.drop("pairs", "pair_n").join(answers, "block", "left").mapInArrow(_answered, RESULT)
