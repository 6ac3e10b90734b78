"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit compares
the n-gram statistics of the languages with a one to those with a zero; its
margin is the mean log ratio over a text's byte trigrams. Decoding adds the
logistic loss of every bit, weighted by how well the bit's classifier separates
its two sides, and takes the codeword of least loss. A text whose second best
codeword is nearly as good is flagged ambiguous.

Trigrams are taken of the UTF-8 bytes with letters lower-cased and everything
else in ASCII as one blank. Null texts and texts without a letter are ``und``
with score 0. Rows with a null language are not learned from; without any
labelled row all is ``und``, with one language all that has a letter is that.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenseek.llm import textarrays as ta
from lumenseek.llm.common import fold, ready

#: Most documents the classifiers are fitted on; they are chosen by hash of the id.
MAX_SAMPLE = 20_000
GRAM, BITS = 3, 15
#: Mean log ratios are worth as much as so many independent trigrams at most.
EVIDENCE = 40.0
AMBIGUOUS = 0.2
#: All splits of up to so many languages are bits; beyond, so many bits per doubling of the languages.
ALL_SPLITS, BITS_PER_DOUBLING = 6, 10

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray) -> np.ndarray:
    """Hashed trigram starting at each byte but the last two."""
    low = _FOLD[data]
    latin = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    low[latin] += 0x20  # capitals of the second half of Latin-1
    wide = low.astype(np.uint32)
    code = wide[:-2] | (wide[1:-1] << np.uint32(8)) | (wide[2:] << np.uint32(16))
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language; every pair of rows differs in about half of the columns."""
    if languages < 2:
        return np.zeros((languages, 0))
    if languages <= ALL_SPLITS:
        splits = np.arange(1, 2 ** (languages - 1))
        bits = (splits[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits == 1, 1.0, -1.0)
    width = int(np.ceil(BITS_PER_DOUBLING * np.log2(languages)))
    best, far = None, -1
    for seed in range(200):
        code = np.where(np.random.default_rng(seed).random((languages, width)) < 0.5, -1.0, 1.0)
        apart = ((code[:, None, :] != code[None, :, :]).sum(axis=2) + width * np.eye(languages)).min()
        split = (np.abs(code.sum(axis=0)) < languages).all()
        if split and apart > far:
            best, far = code, apart
    return best


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        """``counts``: trigrams of each language."""
        self.names, self.code = names, codewords(len(names))
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), dtype=np.float32)
        self.bit = np.ones(self.code.shape[1])
        for b, side in enumerate(self.code.T > 0):
            one, zero = share[side].mean(axis=0), share[~side].mean(axis=0)
            ratio = np.log(one / zero)
            self.weights[:, b] = ratio
            self.bit[b] = ((one - zero) * ratio).sum()  # mean margin of one side less that of the other
        if len(self.bit):
            self.bit /= self.bit.max()

    def margins(self, piece: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = ta.raw(piece)
        n = np.maximum(np.diff(offsets) - GRAM + 1, 0)
        total = np.zeros((len(piece), self.code.shape[1]))
        if len(data) >= GRAM:
            code, full = grams(data), np.flatnonzero(n)
            edges = np.column_stack([offsets[full], offsets[full] + n[full]]).ravel()
            values = np.concatenate([self.weights[code], np.zeros((1, self.weights.shape[1]), np.float32)])
            total[full] = np.add.reduceat(values, edges, axis=0)[::2]
        return total / np.maximum(n, 1)[:, None], n

    def posterior(self, piece: pa.Array) -> np.ndarray:
        margin, n = self.margins(piece)
        scaled = margin * np.minimum(n, EVIDENCE)[:, None]
        loss = np.logaddexp(0, -scaled[:, None, :] * self.code[None, :, :]) * self.bit
        loss = loss.sum(axis=2) / max(self.bit.sum() / 2, 1)
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return e / e.sum(axis=1, keepdims=True)

    def udf(self):
        names = np.array(self.names)

        def predict(text: pa.Array) -> pa.Array:
            parts = [self.posterior(p) for p in ta.pieces(text)]
            p = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            ranked = np.sort(p, axis=1)
            second = ranked[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
            return pa.StructArray.from_arrays([pa.array(names[p.argmax(axis=1)].tolist(), pa.string()), pa.array(p.max(axis=1)),
                                               pa.array(p.max(axis=1) - second < AMBIGUOUS)], ["lang", "score", "ambiguous"])
        return F.arrow_udf(predict, "struct<lang: string, score: double, ambiguous: boolean>")


def _count(batches):
    for batch in batches:
        for language in batch.column(0).unique().to_pylist():
            own = batch.column(1).filter(pa.compute.equal(batch.column(0), language))
            total = np.zeros(1 << BITS, dtype=np.int64)
            for piece in ta.pieces(own):
                data, offsets = ta.raw(piece)
                if len(data) >= GRAM:
                    code = grams(data)
                    keep = np.ones(len(code), dtype=bool)
                    for back in range(1, GRAM):  # not across documents
                        edge = offsets[1:-1] - back
                        keep[edge[(edge >= 0) & (edge < len(code))]] = False
                    total += np.bincount(code[keep], minlength=1 << BITS)
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(code), pa.string()), pa.array(code), pa.array(total[code])],
                                             ["lang", "code", "n"])


def train(labelled: DataFrame, most: int = MAX_SAMPLE) -> Model | None:
    """Fit on at most ``most`` rows of ``labelled(doc_id, text, lang)``."""
    ready(labelled.sparkSession)
    rows = labelled.where("lang is not null and text is not null")
    last = rows.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    if last is None:
        return None
    sample = rows.where(F.xxhash64("doc_id") <= last).select("lang", "text")
    found = sample.mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # languages x 2 ** BITS at most
    names = sorted(table["lang"].unique())
    if not names:
        return None
    counts = np.zeros((len(names), 1 << BITS))
    counts[[names.index(x) for x in table["lang"]], table["code"]] = table["n"]
    return Model(names, counts)


def op5_language(docs: DataFrame) -> DataFrame:
    """Predicted language and score of every document; see the module for nulls, missing labels and ties.

    Repeated rows and ids each give a row, other columns are not read, an empty table gives no rows. A text is one
    piece of its task whatever its length (about 60 times its bytes while it is scored).
    """
    held = fold("doc_id", 5) == 0
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    out = docs.select("doc_id", "text", held.alias("held_out"), letter.alias("letter"))
    found = model.udf()("text") if model else F.expr("cast(null as struct<lang: string, score: double, ambiguous: boolean>)")
    out = out.withColumn("p", found)
    known = F.col("letter") & F.col("p").isNotNull()
    return out.select("doc_id", "held_out", F.when(known, F.col("p.lang")).otherwise("und").alias("lang_pred"),
                      F.when(known, F.col("p.score")).otherwise(0.0).alias("score"),
                      F.when(known, F.col("p.ambiguous")).otherwise(True).alias("ambiguous"))
