"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps characters that look like Latin letters to those,
digits and signs that stand for letters to the letters, and what separates words
to one blank. Terms are whole words or beginnings of words. Their weights are
learned: the lower confidence bound of the log odds of a term in toxic against
other documents. Phrases of a term and a neighbour that are common in other
documents are exceptions: a term inside one does not count.

A text's score is a logistic function of the sum of the weights of its matches
and of that sum by length; one match per word counts, that of the largest
weight. Null and empty texts have no match. Without toxic training rows, or
without any term, every score is the share of toxic rows (0.5 without rows).
"""

from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenseek.llm.common import fold, labelled_sample, ready, staged

#: Most labelled rows that weights are learned from; they are chosen by hash of the id.
MAX_SAMPLE = 12_000
MAX_TERMS, MAX_EXCEPTIONS, LEAST_DOCS, LEAST_WEIGHT = 2_000, 2_000, 3, 1.5
STEMS, LEAST_WORD = (4, 5, 6), 3
THRESHOLD = 0.7

#: Lookalikes of Latin letters (Cyrillic, Greek), and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_TABLE = {c: " " for c in map(chr, range(128)) if not c.isalnum()} | {c: " " for c in " ‘’“”–—…"}
_TABLE |= DIGITS | LOOKALIKES | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
_TABLE |= {chr(0xFF21 + i): chr(0x61 + i) for i in range(26)} | {c: "" for c in "­​‌‍﻿"}
_TABLE = str.maketrans(_TABLE)


def folded(text: str) -> str:
    """Folded words between single blanks, with a blank at both ends."""
    return " " + " ".join(text.lower().translate(_TABLE).split()) + " "


def terms_of(word: str):
    """What a word can match: itself, and its beginnings."""
    if len(word) >= LEAST_WORD:
        yield f" {word} "
        for n in STEMS:
            if n < len(word):
                yield f" {word[:n]}"


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: list[str] = ()):
        self.weights, self.exceptions = weights, list(exceptions)
        self.machine = ahocorasick.Automaton()
        for term, weight in weights.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            self.machine.add_word(phrase, (len(phrase), None))
        if len(self.machine):
            self.machine.make_automaton()

    def __reduce__(self):
        return Lexicon, (self.weights, self.exceptions)

    def matches(self, text: str) -> tuple[str, dict[int, float]]:
        """Folded text, and the weight at each word start that matches outside exceptions."""
        text, best, spans = folded(text), {}, []
        if len(self.machine):
            for end, (size, weight) in self.machine.iter(text):
                start = end - size + 1
                if weight is None:
                    spans.append((start, end))
                elif weight > best.get(start, 0.0):
                    best[start] = weight
        for a, b in spans:
            for start in [s for s in best if a <= s < b]:
                del best[start]
        return text, best

    def features(self, text: str) -> tuple[float, float]:
        text, best = self.matches(text)
        total = sum(best.values())
        return np.log1p(total), np.log1p(100 * total / max(text.count(" ") - 1, 1))


def _bound(n1: Column, n0: Column, toxic: int, other: int) -> Column:
    """Lower confidence bound of the log odds ratio of a term, from its counts plus a half."""
    return F.log(n1 / (toxic + 1)) - F.log(n0 / (other + 1)) - 1.64 * F.sqrt(1 / n1 + 1 / n0)


def _counted(found_in, sample: DataFrame):
    """Rows (what, n1, n0): toxic and other documents of ``sample(label, text)`` that have it."""
    def count(batches):
        for batch in batches:
            both = Counter(), Counter()
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both[label == 1].update(found_in(text or ""))
            what = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array([both[1][w] for w in what], pa.int64()),
                                              pa.array([both[0][w] for w in what], pa.int64())], ["what", "n1", "n0"])
    return (sample.mapInArrow(count, "what string, n1 bigint, n0 bigint").groupBy("what")
            .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def _all_terms(text: str) -> set:
    return {t for w in set(folded(text).split()) for t in terms_of(w)}


def learn(sample: DataFrame, toxic: int, other: int) -> Lexicon:
    """Terms and exceptions of ``sample(label, text)``: the ``MAX_TERMS`` of greatest bound, the ``MAX_EXCEPTIONS`` most harmless.

    Ties go to the smaller term, so the sample alone decides, not the order of its rows.
    """
    n1, n0 = F.col("n1") + 0.5, F.col("n0") + 0.5
    rows = (_counted(_all_terms, sample).where(f"n1 >= {LEAST_DOCS}").withColumn("weight", _bound(n1, n0, toxic, other))
            .where(F.col("weight") >= LEAST_WEIGHT).orderBy(F.desc("weight"), "what").limit(MAX_TERMS).toPandas())
    lexicon = Lexicon(dict(zip(rows["what"], rows["weight"])))

    def phrases(text: str) -> set:
        text, best = lexicon.matches(text)
        out = set()
        for start in best:
            end = text.index(" ", start + 1)
            before, after = text.rfind(" ", 0, start), text.find(" ", end + 1)
            if before >= 0:
                out.add(text[before:end + 1])
            if after >= 0:
                out.add(text[start:after + 1])
        return out

    harmless = (_counted(phrases, sample).where(f"n0 >= {2 * LEAST_DOCS}").where(n0 * (toxic + 1) > n1 * (other + 1))
                .orderBy(F.desc(n0 / n1), "what").limit(MAX_EXCEPTIONS).toPandas())
    return Lexicon(lexicon.weights, sorted(harmless["what"]))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def udf(self):
        def score(text: pa.Array) -> pa.Array:
            x = np.array([self.lexicon.features(t) if t else (0.0, 0.0) for t in text.to_pylist()]).reshape(-1, 2)
            z = np.column_stack([np.ones(len(x)), x]) @ self.weights
            return pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())
        return F.arrow_udf(score, "double")


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of the label on the two features, by Newton's method."""
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, keep=None, most: int = MAX_SAMPLE) -> Model:
    ready(docs.sparkSession)
    chosen = staged(labelled_sample(docs, labels, "toxic", F.lit(True) if keep is None else keep, most)
                    .select("label", "text"), "toxicity-sample")
    counts = {r.label: r.n for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = counts.get(1, 0), sum(n for label, n in counts.items() if label != 1)
    share = (toxic + 0.5) / (toxic + other + 1)
    nothing = Model(Lexicon({}), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    if not toxic or not other:
        return nothing
    lexicon = learn(chosen, toxic, other)
    if not lexicon.weights:
        return nothing

    def features(text: pa.Array) -> pa.Array:
        return pa.array([list(lexicon.features(t or "")) for t in text.to_pylist()], pa.list_(pa.float64()))
    rows = chosen.select("label", F.arrow_udf(features, "array<double>")("text").alias("x")).toPandas()
    x = np.array(rows["x"].tolist())
    order = np.lexsort((x[:, 1], x[:, 0], rows["label"]))
    return Model(lexicon, calibrate(x[order], (rows["label"].to_numpy() == 1).astype(float)[order]))


def op2_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; rows in the held-out fold are never learned from.

    Null and empty texts have no match; repeated rows and ids each give a row; of repeated labels the smaller
    counts; other columns are not read; an empty table gives no rows. A text of any length is matched whole.
    """
    model = train(docs, labels, fold("doc_id", 3) != 1)
    out = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), model.udf()("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
