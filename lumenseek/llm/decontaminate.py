"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item, or all words of an item
of fewer. As a set of word shingles a window is contained in a document only if
its rarest shingle is, so that one shingle is the whole prefix to join on when
shingles are ordered by rarity (counted over all documents). A match places the
window: it starts as far before the shingle as the shingle lies in the window,
and must begin and end inside the document (positional and length bounds). Then
all words are compared, by hash and at last by their bytes.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` that tasks can hold,
every document against each block; documents are never shuffled. Null and empty
texts have no words. Items without words have no windows. Items with a null id
count as hits, not as items; rows of one item id are one item.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenseek.llm import textarrays as ta
from lumenseek.llm.common import ready, staged

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 8 << 20
#: Blocks whose passes share one stage, before the documents are staged.
BLOCKS_AT_ONCE = 4
_BITS = 20


def _words(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = ta.Words(data, np.array([0, len(data)]))
    return [w.data[a:b].tobytes() for a, b in zip(w.starts, w.ends)]


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return ta.Words(data, np.array([0, len(data)])).hashes()


class _Lookup:
    """Places of 64-bit codes in a sorted list; most misses end at a bit table."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[codes & np.uint64((1 << _BITS) - 1)] = True

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bits[codes & np.uint64((1 << _BITS) - 1)])
        place = np.searchsorted(self.codes, codes[at])
        place[place == len(self.codes)] = 0
        hit = self.codes[place] == codes[at] if len(self.codes) else np.zeros(len(at), dtype=bool)
        return at[hit], place[hit]


class Windows:
    """The different windows of one block of items."""

    def __init__(self, items: list[tuple]):
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            words = _words(text or "")
            size = min(WINDOW, len(words))
            for at in range(len(words) - size + 1 if words else 0):
                owners.setdefault(tuple(words[at:at + size]), set()).add(item_id)
        self.words = list(owners)
        self.items = [sorted(x for x in owners[w] if x is not None) for w in self.words]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.hash = np.zeros((len(self.words), WINDOW), dtype=np.uint64)
        for row, w in enumerate(self.words):
            self.hash[row, :len(w)] = _hashes(list(w))

    def shingle_sizes(self) -> list[int]:
        return sorted({min(SHINGLE, int(s)) for s in self.size})

    def shingles(self, row: int) -> np.ndarray:
        size = int(self.size[row])
        return ta.shingles(self.hash[row, :size], min(SHINGLE, size))

    def codes(self) -> dict[int, np.ndarray]:
        """Sorted different shingles, by their size in words."""
        rows = range(len(self.words))
        return {s: np.unique(np.concatenate([self.shingles(r) for r in rows if min(SHINGLE, self.size[r]) == s]))
                for s in self.shingle_sizes()}

    def prefixes(self, counts: dict[int, int]) -> dict:
        """Per shingle size: lookup of the rarest shingles, and the windows (and offsets) of each."""
        found: dict[int, list] = {}
        for row in range(len(self.words)):
            codes = self.shingles(row).tolist()
            at = min(range(len(codes)), key=lambda k: (counts.get(codes[k], 0), k))
            found.setdefault(min(SHINGLE, int(self.size[row])), []).append((codes[at], row, at))
        out = {}
        for size, rows in found.items():
            rows.sort()
            code, window, offset = (np.array(c, dtype=t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int64)))
            unique, first = np.unique(code, return_index=True)
            out[size] = (_Lookup(unique), np.append(first, len(rows)), window, offset)
        return out


def _counting(codes: dict[int, np.ndarray]):
    lookups = {size: _Lookup(c) for size, c in codes.items()}

    def count(batches):
        for batch in batches:
            for piece in ta.pieces(batch.column(0)):
                words = ta.Words(*ta.raw(piece))
                hashes, found = words.hashes(), []
                for size, lookup in lookups.items():
                    inside = ta.whole_rows(words.row, size)
                    at, place = lookup(ta.shingles(hashes, size))
                    found.append(lookup.codes[place[inside[at]]] if len(at) else np.zeros(0, np.uint64))
                code, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])
    return count


def rarity(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents."""
    counted = docs.select("text").mapInArrow(_counting(windows.codes()), "code bigint, n bigint")
    rows = counted.groupBy("code").agg(F.sum("n").alias("n")).collect()  # no more than the block has shingles
    return {r.code & 0xFFFFFFFFFFFFFFFF: r.n for r in rows}


def _match_piece(piece: pa.Array, windows: Windows, prefixes: dict, hit: list, items: list) -> None:
    words = ta.Words(*ta.raw(piece))
    hashes = words.hashes()
    positions: dict[int, set] = {}
    owners: dict[int, set] = {}
    for size, (lookup, first, window, offset) in prefixes.items():
        at, place = lookup(ta.shingles(hashes, size))
        many = first[place + 1] - first[place]
        at = np.repeat(at, many)
        entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[place], many)
        w = window[entry]
        start, row = at - offset[entry], words.row[at]
        fits = (start >= words.first[row]) & (start + windows.size[w] <= words.first[row + 1])
        start, row, w = start[fits], row[fits], w[fits]
        for k in range(WINDOW):
            beyond = windows.size[w] <= k
            same = beyond | (hashes[np.where(beyond, start, start + k)] == windows.hash[w, k])
            start, row, w = start[same], row[same], w[same]
        for s, r, x in zip(start.tolist(), row.tolist(), w.tolist()):
            n = int(windows.size[x])
            if all(words.data[words.starts[s + k]:words.ends[s + k]].tobytes() == windows.words[x][k] for k in range(n)):
                positions.setdefault(r, set()).update(range(s - int(words.first[r]), s - int(words.first[r]) + n))
                owners.setdefault(r, set()).update(windows.items[x])
    hit.extend(sorted(positions[r]) if r in positions else [] for r in range(len(piece)))
    items.extend(sorted(owners[r]) if r in owners else [] for r in range(len(piece)))


def _match_udf(windows: Windows, prefixes: dict):
    def match(text: pa.Array) -> pa.Array:
        hit, items = [], []
        for piece in ta.pieces(text):
            _match_piece(piece, windows, prefixes, hit, items)
        return pa.StructArray.from_arrays([pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
                                          ["hit", "items"])
    return F.arrow_udf(match, "struct<hit: array<int>, items: array<bigint>>")


def _count_udf():
    def count(text: pa.Array) -> pa.Array:
        parts = [ta.Words(*ta.raw(p)).counts for p in ta.pieces(text)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
    return F.arrow_udf(count, "bigint")


def matched(docs: DataFrame, benchmark: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column ``name``: positions of hit words, and the items whose windows occur."""
    ready(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    out = docs.withColumn(name, F.expr("named_struct('hit', cast(array() as array<int>), 'items', cast(array() as array<bigint>))"))
    for block in range(blocks):
        rows = items.where(F.col("block") == block).select("item_id", "text").collect()  # about BLOCK_BYTES
        windows = Windows([tuple(r) for r in rows])
        if not windows.words:
            continue
        more = _match_udf(windows, windows.prefixes(rarity(docs, windows)))("text")
        out = out.withColumn(f"{name}_more", more).withColumn(name, F.struct(
            F.array_union(f"{name}.hit", f"{name}_more.hit").alias("hit"),
            F.array_union(f"{name}.items", f"{name}_more.items").alias("items"))).drop(f"{name}_more")
        if block % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and block < blocks - 1:
            out = staged(out, "decontaminated")
    return out


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words of every document, those in windows of items, and the items; see the module for nulls and items.

    Repeated rows and ids each give a row, other columns are not read, no documents give no rows. A text is one
    piece of its task whatever its length (about 40 times its bytes while it is hashed).
    """
    found = matched(docs.select("doc_id", "text"), benchmark, "found")
    names: Column = F.array_sort(F.transform("found.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", _count_udf()("text").alias("n_words"), F.size("found.hit").cast("bigint").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("found.hit") > 0).alias("contaminated"))


#: DuckDB: every window of the benchmark against every window of the documents.
OP9_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT rid, i, n, item_id FROM (
    SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i) WHERE len(w) >= n) JOIN win USING (n, k)),
hits AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM occ), unnest(generate_series(i, i + n - 1)) AS t(p)
  GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
