"""Near-duplicate classes by Order MinHash, verified by banded alignment.

1. *Copies.* Rows whose texts have the same words are one node from here on, so
   copies never meet each other.
2. *Sketch.* Five-word shingles are labelled with their occurrence number. For
   each of ``ENTRIES`` seeds the ``PICKED`` labelled shingles with the smallest
   hashes are kept in the order in which the text has them; the hash of that
   sequence is the entry. Equal entries want the same shingles in the same
   order, so the chance follows edit similarity. Texts of few shingles have
   entries of single shingles beside these.
3. *Candidates.* The nodes that share an entry are compared with pivots, not with
   each other: first each node with the smallest node of its entries, then, in
   rounds, the nodes outside an entry's largest class with one node of that class
   (in the first round the one with the most links) and with one node of the next
   largest class. Entries whose nodes are of one class are done. Pivots are
   aggregates that combine in the map tasks, and every node has a few tests per
   entry and round, so pairs grow with the nodes of a group, not with their
   square. Once a round joins few classes, the pairs that are left are searched
   without pivots: all shingles have one order, rare ones first, and of two nodes
   of similarity 0.8 the first aligned shingle is among the first fifth of both,
   at nearly the same place of the text. Nodes of entries with several classes
   are joined by the shingles of that fifth, which loses no pair, and each pair of
   two classes is tested that has lengths and places to match and was not tested
   before. ``exhaustive=True`` then compares all pairs of different classes that
   share an entry; it is for tests.
4. *Verification.* Both shingle sequences are aligned inside a band: with M
   shingles aligned, similarity = M / (a + b - M), the ordered form of Jaccard.
   At 0.8 or more at most (a + b) / 9 shingles are unaligned, which is the width
   of the band, so the band loses nothing. Shingles count with their occurrence
   number, so each has one partner at most, and the alignment is the longest
   increasing chain of partners.
5. *Classes.* Connected components of the verified links by minimum labels and
   pointer jumping over staged tables of ids.

Null texts are near nothing, not even each other. A text without words is a
copy of an equal text only. Texts of fewer than five words have one shingle of
all their words. Rows may repeat a ``doc_id``; a class is named by its smallest
``doc_id``. Empty tables give empty results.
"""

import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenseek.llm import textarrays as ta
from lumenseek.llm.common import ready, staged

SHINGLE, SIMILARITY = 5, 0.8
#: An entry of two texts of similarity 0.8 is equal with a chance of about 0.8 ** PICKED = 0.41, so 24
#: entries miss such a pair of long texts with a chance of 3e-6; at similarity 0.2 an entry is equal with 0.002.
#: Few shingles are equal less often (four of five: 0.2), so texts of at most FEW shingles also have their first
#: fifth by code as entries: near texts of at most FEW shingles always share one of those.
ENTRIES, PICKED = 24, 4
FEW = 64
#: Pivots give way to the search by rare shingles when a round links a smaller share of its tests. This and
#: the next two decide what the search costs, not what it finds.
YIELD = 0.001
#: Nodes whose shingles are counted to learn the frequent ones, and the most frequent ones known.
COUNTED, FREQUENT = 20_000, 100_000
_SEEDS = ta.mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_CELLS = 1 << 18


def shingle_codes(hashes: np.ndarray) -> np.ndarray:
    """Labelled five-word shingles of one text, in order; no two are equal."""
    if len(hashes) == 0:
        return hashes
    codes = ta.shingles(hashes, min(SHINGLE, len(hashes)))
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    head = np.ones(len(codes), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=head[1:])
    if head.all():
        return codes
    at = np.arange(len(codes))
    number = np.empty(len(codes), dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(head, at, 0))
    return np.where(number > 0, ta.mix(codes + number * np.uint64(0xD1B54A32D192ED03)), codes)


def _fifth(size: int) -> int:
    """Shingles of a text, in any common order, among which is the first that is aligned with a near text's."""
    return size - int(np.ceil(SIMILARITY * size - 1e-9)) + 1


def sketch(codes: np.ndarray) -> np.ndarray:
    """Order MinHash of one text's labelled shingles."""
    picked, step = min(PICKED, len(codes)), max(1, _CELLS // len(codes))
    out = []
    for at in range(0, ENTRIES, step):
        seeds = _SEEDS[at:at + step, None]
        h = (codes[None, :] ^ seeds) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        where = np.argpartition(h, picked - 1, axis=1)[:, :picked] if picked < len(codes) \
            else np.broadcast_to(np.arange(picked), h.shape)
        value = seeds[:, 0].copy()
        for column in codes[np.sort(where, axis=1)].T:
            value = value * np.uint64(0x9E3779B97F4A7C15) + column
        out.append(ta.mix(value))
    if len(codes) <= FEW:
        out.append(ta.mix(np.sort(codes)[:_fifth(len(codes))] + np.uint64(0xA0761D6478BD642F)))
    return np.concatenate(out)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Ordered Jaccard of two sequences of labelled shingles; 0 where it is below ``SIMILARITY``."""
    total = len(a) + len(b)
    if not len(a) or not len(b):
        return 0.0
    if np.array_equal(a, b):
        return 1.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    least = SIMILARITY * total / (1 + SIMILARITY) - 1e-9
    close = np.abs(i - j) <= total - 2 * least
    i, j = i[close], j[close]
    if len(i) < least:
        return 0.0
    partner = j[np.argsort(i)]
    matched = len(partner)
    if (np.diff(partner) < 0).any():
        tails: list[int] = []
        for x in partner.tolist():
            at = bisect_left(tails, x)
            tails[at:at + 1] = [x]
        matched = len(tails)
    return matched / (total - matched) if matched >= least else 0.0


def _each_text(text: pa.Array):
    """Word hashes of each row."""
    for piece in ta.pieces(text):
        words = ta.Words(*ta.raw(piece))
        hashes = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield hashes[a:b]


def sketch_udf():
    def compute(text: pa.Array) -> pa.Array:
        rows = [sketch(shingle_codes(h)).view(np.int64) if len(h) else None for h in _each_text(text)]
        return pa.array(rows, pa.list_(pa.int64()))
    return F.arrow_udf(compute, "array<bigint>")


def shingles_udf():
    def compute(text: pa.Array) -> pa.Array:
        return pa.array([shingle_codes(h).view(np.int64) for h in _each_text(text)], pa.list_(pa.int64()))
    return F.arrow_udf(compute, "array<bigint>")


def first_shingles(codes: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first fifth of a text's shingles in the common order: by place in ``frequent`` (the others first), then by code.

    ``frequent`` has two rows: codes in ascending order, and the place of each. With M >= 0.8 of the
    shingles of a and b aligned, a - M of a and b - M of b are not, so the first aligned shingle comes
    before place a - M + 1 and b - M + 1.
    """
    at = np.minimum(np.searchsorted(frequent[0], codes), max(len(frequent[0]) - 1, 0))
    weight = np.where(frequent[0][at] == codes, frequent[1][at], 0) if len(frequent[0]) else np.zeros(len(codes), np.uint64)
    return np.lexsort((codes, weight))[:_fifth(len(codes))]


_FIRST = "code bigint, rank int, at int, size int"


def first_udf(frequent: np.ndarray):
    fields = [("code", pa.int64()), ("rank", pa.int32()), ("at", pa.int32()), ("size", pa.int32())]

    def compute(text: pa.Array) -> pa.Array:
        ends, columns = [0], ([], [], [], [])
        for h in _each_text(text):
            codes = shingle_codes(h)
            at = first_shingles(codes, frequent) if len(codes) else np.zeros(0, np.int64)
            for column, values in zip(columns, (codes[at].view(np.int64), np.arange(len(at)), at, np.full(len(at), len(codes)))):
                column.append(values)
            ends.append(ends[-1] + len(at))
        flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), t) for c, (_, t) in zip(columns, fields)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, names=[n for n, _ in fields]))
    return F.arrow_udf(compute, f"array<struct<{_FIRST.replace(' ', ':').replace(',:', ',')}>>")


def words_udf():
    """128-bit hash of the word sequence; null for a text without words."""
    def compute(text: pa.Array) -> pa.Array:
        out = []
        for h in _each_text(text):
            out.append(b"".join(ta.sequence_hash(x).to_bytes(8, "big") for x in (h, ta.mix(h + np.uint64(1))))
                       if len(h) else None)
        return pa.array(out, pa.binary())
    return F.arrow_udf(compute, "binary")


def similarity_udf():
    def compute(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(_each_text(left), _each_text(right))
        return pa.array([similarity(shingle_codes(a), shingle_codes(b)) for a, b in pairs], pa.float64())
    return F.arrow_udf(compute, "double")


def _identity() -> "F.Column":
    """What copies have in common: the word sequence, or the text of a wordless row; null for a null text."""
    return F.coalesce(words_udf()("text"), F.unhex(F.sha2("text", 256)))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``class`` (its smallest node) for every node of ``links(a, b)``.

    Each step takes the smallest label of the neighbours, then that label's own
    label. Minima combine in the map tasks, so a hub costs no more than its links.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("class")), "near-labels")
    while True:
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "class")
        best = (near.select("node", "class", F.lit(None).cast("bigint").alias("old"))
                .union(labels.select("node", "class", F.col("class").alias("old")))
                .groupBy("node").agg(F.min("class").alias("class"), F.max("old").alias("old")))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        stepped = staged(best.join(jump, "class").select("node", F.least("class", "next").alias("class"), "old"),
                         "near-labels")
        labels = stepped.select("node", "class")
        if stepped.where("class <> old").isEmpty():
            return labels


class _Search:
    """Classes of nodes, joined entry by entry."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes
        self.labels = self.texts = self.tested = None

    def fetch(self, nodes: DataFrame) -> DataFrame:
        """Text of each of ``nodes(node)``, from the row that stands for it."""
        wanted = self.nodes.join(nodes, "node").select("node", "same", "doc")
        rows = self.docs.join(wanted.select("doc"), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
        rows = rows.select("text", _identity().alias("same")).where("same is not null")
        return rows.join(wanted, "same").select("node", "text").dropDuplicates(["node"])

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Align ``pairs(a, b, class_a, class_b)`` of different classes and join the classes of near ones."""
        near = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = pairs.groupBy(near.alias("p")).agg(F.first("class_a").alias("class_a"), F.first("class_b").alias("class_b"))
        left, right = (self.texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        scored = staged(pairs.select("p.*", "class_a", "class_b").join(left, "a").join(right, "b").select(
            "a", "b", "class_a", "class_b", similarity_udf()("text_a", "text_b").alias("similarity")), "near-tests")
        failed = scored.where(F.col("similarity") < SIMILARITY).select("a", "b")
        self.tested = failed if self.tested is None else self.tested.union(failed)
        found = scored.where(F.col("similarity") >= SIMILARITY)
        if not found.isEmpty():
            joined = components(found.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
            old = joined.select("node", F.col("node").alias("class"))
            if self.labels is not None:
                old = self.labels.union(old.join(self.labels, "node", "left_anti"))
            to = joined.select(F.col("node").alias("class"), F.col("class").alias("to"))
            self.labels = staged(old.join(to, "class", "left").select("node", F.coalesce("to", "class").alias("class")), "near-labels")
        return scored

    def classed(self, df: DataFrame) -> DataFrame:
        """``df`` with the class of its column ``node``."""
        if self.labels is None:
            return df.withColumn("class", F.col("node"))
        return df.join(self.labels, "node", "left").withColumn("class", F.coalesce("class", "node"))

    def entries(self, members: DataFrame, number: int, degree: DataFrame | None) -> DataFrame:
        """Members of entries with several classes, with a pivot of the largest and one of the next largest class."""
        state = self.classed(members)
        weight = F.xxhash64("node", F.lit(number))
        if degree is not None:
            state, weight = state.join(degree, "node", "left"), F.coalesce("degree", F.lit(0))
        own = state.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(weight.alias("w"), "node")).alias("top"))
        ranked = F.struct("n", F.xxhash64("class", F.lit(number)).alias("w"), "class", F.col("top.node").alias("node"))
        keys = (own.groupBy("key").agg(F.max(ranked).alias("one"), F.count(F.lit(1)).alias("classes"))
                .where("classes > 1").select("key", "one"))
        two = (own.join(keys, "key").where(F.col("class") != F.col("one.class"))
               .groupBy("key", "one").agg(F.max(ranked).alias("two")))
        return staged(state.select("key", "node", "class").join(two, "key"), "near-members")

    def rest(self, members: DataFrame) -> DataFrame:
        """Pairs of different classes among the nodes of ``members`` that may be near and were not tested."""
        nodes = self.classed(members.select("node").distinct())
        counted = self.texts.orderBy(F.xxhash64("node"), "node").select("node").limit(COUNTED)
        counts = (self.texts.join(counted, "node").select(F.explode(shingles_udf()("text")).alias("code"))
                  .groupBy("code").count().where("count > 2").orderBy(F.desc("count"), "code").limit(FREQUENT))
        codes = np.array([r.code for r in counts.collect()][::-1], dtype=np.int64).view(np.uint64)
        order = np.argsort(codes)
        frequent = np.stack([codes[order], (order + 1).astype(np.uint64)])
        firsts = (self.texts.join(nodes, "node").select("node", "class", F.explode(first_udf(frequent)("text")).alias("f"))
                  .select("node", "class", "f.*"))
        firsts = staged(firsts, "near-firsts")
        left, right = (firsts.select("code", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "class", "rank", "at", "size")]) for s in "ab")
        total, least = F.col("size_a") + F.col("size_b"), F.col("least")
        pairs = left.join(right, "code").where("node_a < node_b and class_a <> class_b")
        pairs = pairs.withColumn("least", F.lit(SIMILARITY / (1 + SIMILARITY)) * total - 1e-6)
        pairs = pairs.where((F.least("size_a", "size_b") >= least) & (F.col("rank_a") <= F.col("size_a") - least)
                            & (F.col("rank_b") <= F.col("size_b") - least)
                            & (F.least("at_a", "at_b") + 1 + F.least(F.expr("size_a - at_a - 1"), F.expr("size_b - at_b - 1")) >= least))
        pairs = (pairs.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
                 .agg(F.first("class_a").alias("class_a"), F.first("class_b").alias("class_b")))
        return pairs.join(self.tested.distinct(), ["a", "b"], "left_anti")

    def run(self, members: DataFrame, exhaustive: bool) -> None:
        """Compare ``members(key, node)``."""
        pivots = members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        members = staged(members.join(pivots, "key").select("key", "node", "low"), "near-members")
        self.texts = staged(self.fetch(members.select("node").distinct()), "near-texts")
        first = members.where("node <> low").groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b"))
        tests = self.verify(first.select("a", "b", F.col("a").alias("class_a"), F.col("b").alias("class_b")))
        links = tests.where(F.col("similarity") >= SIMILARITY).select(F.explode(F.array("a", "b")).alias("node"))
        degree, number = links.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), 0
        members = members.select("key", "node")
        while True:
            open_ = self.entries(members, number, degree)
            members, degree, number = open_.select("key", "node"), None, number + 1
            outside = open_.where("class <> one.class")
            pairs = outside.select(F.col("node").alias("a"), F.col("class").alias("class_a"),
                                   F.explode(F.array("one", "two")).alias("p")).where("class_a <> p.class")
            tests = self.verify(pairs.select("a", F.col("p.node").alias("b"), "class_a", F.col("p.class").alias("class_b")))
            seen = tests.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("similarity") >= SIMILARITY, 1)).alias("near")).first()
            if seen.near <= YIELD * seen.n:
                break
        self.verify(self.rest(members))
        if exhaustive:
            rest = self.classed(members)
            other = rest.select("key", F.col("node").alias("b"), F.col("class").alias("class_b"))
            self.verify(rest.select("key", F.col("node").alias("a"), F.col("class").alias("class_a")).join(other, "key")
                        .where("a < b and class_a <> class_b"))


def near_classes(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """``same`` (identity of a text), ``head`` (doc and same of the row that stands for its class) and ``class_size``."""
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", _identity().alias("same"), sketch_udf()("text").alias("sketch"))
    grouped = (rows.where("same is not null").groupBy("same")
               .agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch")))
    nodes = staged(grouped.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    search = _Search(docs, nodes)
    search.run(nodes.select(F.explode("sketch").alias("key"), "node"), exhaustive)
    classed = search.classed(nodes.select("node", "same", "doc", "copies"))
    heads = classed.groupBy("class").agg(F.min(F.struct("doc", "same")).alias("head"), F.sum("copies").alias("class_size"))
    out = classed.join(heads, "class").select("same", "head", "class_size")
    return staged(out, "near-classes")


def with_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id``, ``class_size`` and ``stays`` (this text stands for its class) for every row."""
    ready(docs.sparkSession)
    classes = near_classes(docs)
    rows = docs.select("doc_id", _identity().alias("same"))
    return rows.join(classes, "same", "left").select(
        "doc_id", F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("head.doc")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("same").isNull() | (F.col("same").eqNullSafe(F.col("head.same")) & F.col("doc_id").eqNullSafe(F.col("head.doc"))))
        .alias("stays"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, one of each class: that with the smallest ``doc_id``; null texts all stay.

    Columns of any name are kept as they are; helper columns have names that no table has.
    """
    ready(docs.sparkSession)
    classes = near_classes(docs)
    doc, head, same = (f"{name}_{uuid.uuid4().hex}" for name in ("doc", "head", "same"))
    heads = classes.select(F.col("head.doc").alias(doc), F.col("head.same").alias(head)).distinct()
    marked = docs.withColumn(same, _identity())
    kept = (marked.where(F.col(same).isNotNull())
            .join(heads, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(same) == F.col(head)))
            .dropDuplicates([doc, head]))
    return kept.select(docs.columns).union(docs.where("text is null"))


def op4_near_dedup(docs: DataFrame) -> DataFrame:
    """Class and number of links of every row; null texts are classes of their own, see the module for other cases."""
    return with_classes(docs)
