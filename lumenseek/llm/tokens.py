"""Token counts by a two-tier lookup on the map side; nothing is shuffled.

A byte pair encoder works on each pre-token by itself, so a text's count is the
sum over its pre-tokens. The lengths of the pre-tokens that are frequent in a
bounded sample of documents are broadcast; the rest are encoded when a worker
first meets them and stay in its cache. The sample changes speed only.

Texts in which every character lies below U+0250 are cut by ``PRE_TOKEN`` here;
all others are normalised and cut by the library's own steps, and their
pre-tokens looked up in the same way. Only texts that hold a special string go
through the library as a whole. Null texts are empty and have no tokens;
repeated rows and ids each give a row; other columns are not read; an empty
table gives no rows. A text of any length is one row, held with its pre-tokens.
"""

import uuid
from collections import Counter as Counts

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumenseek.llm.common import ready

#: Fixed value: the pattern of the vocabulary's own pre-tokenizer, after lower-casing.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_LIMIT = "ɏ"
#: About so many documents, chosen by hash of the id, make the broadcast table; its most entries.
SAMPLE_DOCS, FREQUENT = 2_000, 50_000
#: Entries a worker keeps besides; beyond, it encodes again.
CACHE = 500_000
LIMIT_TOKENS = 2048

_find = regex.compile(PRE_TOKEN).findall
_unusual = regex.compile(rf"[^\x00-{PLAIN_LIMIT}]").search


class Lengths(dict):
    """Tokens of a pre-token; a miss is encoded and kept."""

    def __init__(self, frequent: dict, encode):
        super().__init__(frequent)
        self.room, self.encode = len(frequent) + CACHE, encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(self) < self.room:
            self[piece] = n
        return n


class Counter:
    """Counts tokens of texts; made once per worker."""

    def __init__(self, definition: str, frequent: dict):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lengths = Lengths(frequent, lambda piece: self.tokenizer.encode(piece, add_special_tokens=False).ids)
        # Pre-tokens of the library are in its byte alphabet, so they have their own table.
        self.wide = Lengths({}, self.tokenizer.model.tokenize)

    def pre_tokens(self, text: str) -> tuple[Lengths, list[str]] | None:
        """A text's pre-tokens and the table they are looked up in; None if it holds a special string."""
        low = text.lower()
        if any(s in text or s in low for s in self.special):
            return None
        if not _unusual(text):
            return self.lengths, _find(low)
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return self.wide, [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def __call__(self, text: str) -> int:
        found = self.pre_tokens(text)
        if found is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        lengths, pieces = found
        return sum(map(lengths.__getitem__, pieces))


_counters: dict = {}


def _counter(key: str, definition, frequent) -> Counter:
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(definition.value, frequent.value)
    return _counters[key]


def frequent_lengths(docs: DataFrame, definition, nothing) -> dict:
    """Lengths of the commonest pre-tokens of a sample; a batch of it leaves its task as counts."""
    key = uuid.uuid4().hex

    def counted(batches):
        for batch in batches:
            counter, counts = _counter(key, definition, nothing), Counts()
            for text in batch.column(0).to_pylist():
                found = counter.pre_tokens(text or "")
                if found and found[0] is counter.lengths:
                    counts.update(found[1])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"])

    every = max(1, docs.count() // SAMPLE_DOCS)
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(counted, "piece string, n bigint")
    rows = sample.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(FREQUENT).collect()
    counter = Counter(definition.value, {})
    return {r.piece: counter.lengths[r.piece] for r in rows}


def token_count(spark: SparkSession, docs: DataFrame, path: str):
    """A column function that counts the tokens of a text column for the vocabulary file at ``path``."""
    ready(spark)
    with open(path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    nothing = spark.sparkContext.broadcast({})
    frequent = spark.sparkContext.broadcast(frequent_lengths(docs, definition, nothing))

    key = uuid.uuid4().hex

    def count(text: pa.Array) -> pa.Array:
        counter = _counter(key, definition, frequent)
        return pa.array([counter(t) if t else 0 for t in text.to_pylist()], pa.int64())
    return F.arrow_udf(count, "bigint")


def op8_tokens(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it has more than ``LIMIT_TOKENS``; null texts have none."""
    n: Column = token_count(spark, docs, path)("text")
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"),
                       n.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > LIMIT_TOKENS)
