"""Document fingerprints from closed syncmers; DataFrame functions only.

A k-mer is four consecutive words, its inner substrings are its three pairs of
neighbours. It is a closed syncmer if the pair with the smallest hash is the
first or the last. Whether a k-mer is chosen depends on nothing outside it, so
the same passage gives the same anchors wherever it stands, and an edit changes
only the anchors of the k-mers it touches. About two thirds of all k-mers are
anchors.

The fingerprint is the list of all anchors in text order: the hash (32 bits,
eight hex digits) and the word position (hex) where it first stands, however
long the text. Likeness is positional: anchors of two texts are paired by hash,
pairs that follow each other at one offset form a run, and the heaviest chain of
runs that go forward in both texts is the matched part. Likeness is the matched
anchors over those of both texts together. The same passages in another order
thus match only as far as their order agrees.

Words are runs of letters and digits; an ideograph is a word of its own. A text
without an anchor (fewer than four words, mostly) has one: the hash of the text.
Null texts count as empty. Repeated and null ids are ordered by id, null last,
then by text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenseek.llm.common import bind

#: Rows of an id range, on average, and the most ranges; ranges grow beyond that.
RANGE_ROWS, MAX_RANGES = 512, 20_000
_SPLIT = r"[^\p{L}\p{N}]+|(?<=[\x{2E80}-\x{9FFF}])|(?=[\x{2E80}-\x{9FFF}])"


#: Masks of the lower half of a number, and of a position without its side.
_LOW, _PLACE = (1 << 32) - 1, (1 << 31) - 1


def _pairs(text: Column) -> Column:
    """Hash of every pair of neighbouring words."""
    words = F.array_remove(F.split(text, _SPLIT), "")
    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.zip_with(
        F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b)))


def _syncmer(pairs: Column, first: Column, at: Column) -> Column:
    """32-bit hash of the k-mer that starts at a pair if it is a closed syncmer, else null."""
    return bind(F.get(pairs, at + 2), lambda last: F.when(
        last.isNotNull() & (F.get(pairs, at + 1) >= F.least(first, last)), F.shiftrightunsigned(F.xxhash64(first, last), 32)))


def anchors(text: Column) -> Column:
    """Word position and hash of every closed syncmer, in text order."""
    return bind(_pairs(text), lambda s: F.filter(
        F.transform(s, lambda x, i: F.struct(i.alias("position"), _syncmer(s, x, i).alias("code"))), lambda a: a["code"].isNotNull()))


def placed(text: Column) -> Column:
    """The fingerprint as numbers in order of the hash: hash in the upper 32 bits, first word position in the lower."""
    found = bind(_pairs(text), lambda s: F.array_compact(F.transform(s, lambda x, i: F.shiftleft(_syncmer(s, x, i), 32) + i)))
    whole = F.array(F.shiftleft(F.shiftrightunsigned(F.xxhash64(text, F.lit("text")), 32), 32))
    return bind(found, lambda c: F.when(F.size(c) == 0, whole).otherwise(bind(F.array_sort(c), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.get(s, i - 1), 32))))))


def as_text(fingerprint: Column) -> Column:
    """Anchors in text order, comma between them: eight hex digits of the hash, then the position in hex."""
    turned = F.array_sort(F.transform(fingerprint, lambda x: F.shiftleft(x, 32) + F.shiftrightunsigned(x, 32)))
    return F.array_join(F.transform(turned, lambda x: F.concat(
        F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_LOW)))), 8, "0"), F.lower(F.hex(F.shiftright(x, 32))))), ",")


def _paired(a: Column, b: Column) -> Column:
    """Positions in both texts (first text in the upper 32 bits) of the anchors they share, in order of the first."""
    def sided(x: Column, side: int) -> Column:
        return F.shiftleft(F.shiftright(x, 32), 32) + F.lit(side << 31) + x.bitwiseAND(F.lit(_LOW))

    def together(s: Column) -> Column:
        # A hash stands once on each side, so its pair is next to each other.
        return F.array_compact(F.transform(s, lambda x, i: bind(F.get(s, i + 1), lambda y: F.when(
            F.shiftright(x, 32) == F.shiftright(y, 32), F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 32) + y.bitwiseAND(F.lit(_PLACE))))))

    both = F.concat(F.transform(a, lambda x: sided(x, 0)), F.transform(b, lambda x: sided(x, 1)))
    return F.array_sort(bind(F.array_sort(both), together))


def _runs(pairs: Column) -> Column:
    """Maximal runs of pairs at one offset: first and last place in the second text, number of pairs."""
    offset = lambda x: F.shiftright(x, 32) - x.bitwiseAND(F.lit(_PLACE))
    heads = F.array_compact(F.transform(pairs, lambda x, i: F.when(
        (i == 0) | (offset(x) != offset(F.get(pairs, i - 1))), i)))
    return bind(heads, lambda h: F.transform(h, lambda start, k: bind(F.coalesce(F.get(h, k + 1), F.size(pairs)), lambda end: F.struct(
        F.get(pairs, start).bitwiseAND(F.lit(_PLACE)).alias("first"), F.get(pairs, end - 1).bitwiseAND(F.lit(_PLACE)).alias("last"),
        (end - start).alias("n")))))


def matched(a: Column, b: Column) -> Column:
    """Anchors in the heaviest chain of runs that go forward in both texts."""
    nothing = F.array().cast("array<struct<last:bigint,total:int>>")

    def step(chains: Column, run: Column) -> Column:
        before = F.array_max(F.transform(F.filter(chains, lambda c: c["last"] < run["first"]), lambda c: c["total"]))
        return F.concat(chains, F.array(F.struct(run["last"].alias("last"), (run["n"] + F.coalesce(before, F.lit(0))).alias("total"))))

    best = F.array_max(F.transform(F.aggregate(bind(_paired(a, b), _runs), nothing, step), lambda c: c["total"]))
    return F.coalesce(best, F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Share of matched anchors among those of both fingerprints."""
    return bind(F.when(a == b, F.size(a)).otherwise(matched(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below the key, by halving steps."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(table, at + step - 1) < key, F.lit(False)), at + step).otherwise(at))


def with_next(docs: DataFrame, more: dict[str, Column]) -> DataFrame:
    """``doc_id``, ``text`` and the columns ``more`` of every row, with ``next_...`` of the row that follows.

    Rows are ordered by descending id; after the last comes the first. Ids are
    cut into ranges by quantiles; texts are shuffled once, to their range, and
    the row after a range's last is the first of the next range, fetched by id.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    many = max(1, min(MAX_RANGES, -(-docs.count() // RANGE_ROWS)))
    at = [k / many for k in range(1, many)]
    found = rows.agg(F.percentile_approx("key", at, 100 * many).alias("b")).first()[0] if at else None
    bounds = sorted(set(found or []))
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds)).withColumn("tie", F.xxhash64("text"))
    # The first row of each range: the largest id, and of those the smallest hash.
    firsts = rows.groupBy("range").agg(F.max(F.struct("key", F.bitwise_not("tie").alias("tie"))).alias("head")).collect()
    firsts.sort(key=lambda r: -r.range)
    following = ";".join(f"{r.range},{n.head.key},{~n.head.tie}" for r, n in zip(firsts, firsts[1:] + firsts[:1]))
    edges = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(following), ";")).alias("e"))  # one row per range
    edges = edges.where("e <> ''").select(*[F.split("e", ",")[i].cast("bigint").alias(c) for i, c in enumerate(("to", "k", "t"))])
    fetched = (rows.select("key", "tie", "text").join(F.broadcast(edges), F.expr("key = k and tie = t"))
               .groupBy("to").agg(F.first("text").alias("text")))
    carried = ["text", *more]
    fetched = fetched.withColumns(more).select("to", *[F.col(c).alias(f"edge_{c}") for c in carried])
    order = Window.partitionBy("range").orderBy(F.desc("key"), "tie")
    placed = rows.repartition("range").withColumns(more)
    placed = placed.withColumns({**{f"next_{c}": F.lead(c).over(order) for c in carried}, "last": F.lead(F.lit(True)).over(order).isNull()})
    # Not equal by name: the optimizer would carry the formula of the range over to the other side, where it has no key.
    out = placed.join(fetched, (F.col("range") == F.abs(F.col("to")).cast("int")) & F.col("last"), "left")
    return out.select("doc_id", *carried, *[F.coalesce(f"next_{c}", f"edge_{c}").alias(f"next_{c}") for c in carried])


def op7_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like it is to that and to the next document.

    Null texts are empty; a text without an anchor is alike to equal texts only; repeated rows and ids each give a
    row; other columns are not read; an empty table gives no rows. A text of any length is one row.
    """
    rows = with_next(docs, {"codes": placed(F.col("text"))})
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = (rows.withColumn("n_chars", n.cast("bigint")).withColumn("edited", edited)
            .select("doc_id", "n_chars", "codes", "next_codes", "edited", placed(F.col("edited")).alias("edited_codes")))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("codes")).alias("fingerprint"),
                       as_text(F.col("edited_codes")).alias("edited_fingerprint"),
                       likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
                       likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
