"""Quality classifier: gradient-boosted trees over document statistics.

The statistics describe a text's shape (character classes, word lengths,
repetition, lines), not its vocabulary, so one model serves all languages.
Trees grow on histograms of a bounded sample of labelled documents
(``MAX_SAMPLE``); every tree is a full binary tree stored in flat arrays, and a
batch of documents walks all trees level by level in numpy.

Null and empty texts have all-zero statistics and get the score of those.
Without labelled rows, or with labels of one kind, every score is the share of
ones (0.5 without rows).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenseek.llm import textarrays as ta
from lumenseek.llm.common import fold, labelled_sample, ready

#: Most labelled rows the trees are fitted on; they are chosen by hash of the id.
MAX_SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, RIDGE = 60, 4, 64, 0.25, 8, 1.0
THRESHOLD = 0.7

#: Character classes of bytes: 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 line end, 6 stop and comma,
#: 7 exclamation and question, 8 bar, 9 other ASCII punctuation, 10 above ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[33, *range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 9
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5
_CLASS[[44, 46]], _CLASS[[33, 63]], _CLASS[124], _CLASS[128:] = 6, 7, 8, 10


def _repetition(row: np.ndarray, codes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: number of different codes, and how often the commonest occurs."""
    different, most = np.zeros(rows), np.zeros(rows)
    if len(row):
        key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (codes >> np.uint64(24)))
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        run = np.diff(np.append(head, len(key)))
        owner = (key[head] >> np.uint64(40)).astype(np.int64)
        different = np.bincount(owner, minlength=rows).astype(float)
        np.maximum.at(most, owner, run)
    return different, most


def statistics(column: pa.Array) -> np.ndarray:
    """One row of numbers per text."""
    parts = [_piece_statistics(p) for p in ta.pieces(column)]
    return np.concatenate(parts) if parts else np.zeros((0, 23))


def _piece_statistics(piece: pa.Array) -> np.ndarray:
    data, offsets = ta.raw(piece)
    rows, size = len(piece), np.diff(offsets)
    kinds = np.bincount((np.repeat(np.arange(rows), size) << 4) | _CLASS[data], minlength=rows * 16)
    kinds = kinds.reshape(rows, 16)[:, 1:11].astype(float)
    words = ta.Words(data, offsets)
    codes, length = words.hashes(), (words.ends - words.starts).astype(float)
    n = np.maximum(words.counts, 1)
    mean = np.bincount(words.row, length, rows) / n
    spread = np.sqrt(np.maximum(np.bincount(words.row, length ** 2, rows) / n - mean ** 2, 0))
    different, most = _repetition(words.row, codes, rows)
    pair = ta.whole_rows(words.row, 2)
    twice = np.bincount(words.row[:-1][pair], (codes[1:] == codes[:-1])[pair], rows) if len(codes) > 1 else np.zeros(rows)
    pairs, _ = _repetition(words.row[:-1][pair], ta.shingles(codes, 2)[pair], rows) if len(codes) > 1 else (np.zeros(rows), 0)
    lines = kinds[:, 4] + 1
    columns = [np.log1p(size), np.log1p(words.counts), mean, spread, different / n, most / n, twice / n,
               pairs / np.maximum(words.counts - 1, 1), np.log1p(lines), words.counts / lines,
               kinds[:, 0] / np.maximum(kinds[:, 0] + kinds[:, 1], 1),
               (kinds[:, 5] + kinds[:, 6] + kinds[:, 7] + kinds[:, 8]) / n]
    return np.column_stack([*columns, kinds / np.maximum(size, 1)[:, None], (size == 0).astype(float)])


class Trees:
    """Boosted trees in flat arrays: node i has the children 2i+1 and 2i+2."""

    def __init__(self, prior: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.prior, self.feature, self.cut, self.leaf = prior, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, at = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            total += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss on at most ``BINS`` bins per statistic."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior, inner = float(np.log(share / (1 - share))), 2 ** DEPTH - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(prior, *(np.zeros((0, inner)) for _ in range(3)))
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)])
    width, flat = x.shape[1], binned + np.arange(x.shape[1]) * BINS
    features, limits, leaves = [], [], []
    total = np.full(len(y), prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            base, many = 2 ** level - 1, 2 ** level
            slot = ((node - base)[:, None] * width * BINS + flat).ravel()
            g, h, n = (np.bincount(slot, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS)
                       .cumsum(axis=2) for v in (grad, hess, np.ones(len(y))))
            gt, ht, nt = g[:, :, -1:], h[:, :, -1:], n[:, :, -1:]
            gain = g ** 2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(n < LEAST) | (nt - n < LEAST)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[base + k], limit[base + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        node -= inner
        leaf = -RATE * np.bincount(node, grad, inner + 1) / (np.bincount(node, hess, inner + 1) + RIDGE)
        total += leaf[node]
        features.append(feature), limits.append(limit), leaves.append(leaf)
    return Trees(prior, np.array(features), np.array(limits), np.array(leaves))


def statistics_udf():
    def compute(text: pa.Array) -> pa.Array:
        x = statistics(text)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32), pa.array(x.ravel()))
    return F.arrow_udf(compute, "array<double>")


def score_udf(trees: Trees):
    def compute(text: pa.Array) -> pa.Array:
        return pa.array(trees.score(statistics(text)), pa.float64())
    return F.arrow_udf(compute, "double")


def train(docs: DataFrame, labels: DataFrame, keep=None, most: int = MAX_SAMPLE) -> Trees:
    """Fit on labelled documents for whose ``doc_id`` ``keep`` holds."""
    ready(docs.sparkSession)
    keep = F.lit(True) if keep is None else keep
    sample = labelled_sample(docs, labels, "quality", keep, most)
    rows = sample.select("label", statistics_udf()("text").alias("x"), F.xxhash64("doc_id", "text").alias("o")).toPandas()
    rows = rows.sort_values("o", kind="stable")  # the same order whatever the partitions were
    x = np.array(rows["x"].tolist()) if len(rows) else statistics(pa.array([], pa.string()))
    return fit(x, rows["label"].to_numpy(dtype=float))


def scored(docs: DataFrame, trees: Trees, name: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` with the probability of good quality; a column of that name is replaced."""
    ready(docs.sparkSession)
    return docs.withColumn(name, score_udf(trees)("text"))


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; rows in the held-out fold are never learned from.

    Repeated rows and ids each give a row; of repeated labels the smaller counts; other columns are not read; an
    empty table gives no rows. A text is one piece of its task whatever its length.
    """
    trees = train(docs, labels, fold("doc_id", 4) != 2)
    out = scored(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
