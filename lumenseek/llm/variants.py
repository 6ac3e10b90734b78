"""Spelling variants: words one edit apart, found through pivotal grams.

Every word has bigrams; they are ordered by how many words have them, rarest
first. A word's *prefix* is its three rarest bigrams (with all ties of the
third); two of them that share no character are its *pivots*, chosen by dynamic
programming for the least sum of frequencies. One edit destroys at most one of
two disjoint pivots, so of two words at distance one, the one whose prefix ends
earlier in the order has a pivot that is in the prefix of the other one.

Position limits make the join on pivots narrow. If the edit lies right of the
left pivot, that pivot and all before it are the same in both words; otherwise
the right pivot and all after it are. What remains on the far side of that pivot
is halved: the edit spares one half, which therefore agrees as well, at the
place that the difference in length implies. A key is the pivot with its
context, the spared half and the length; indexed pivots have one key for each
difference in length, prefix grams one for their own place. Pairs that meet are
verified. Keys hold about half of a word, so few other words share them; a key
that many share is split by adaptive execution.

Only bigram frequencies reach the driver: letters here are a to z and U+00C0 to
U+00FF, so there are at most 8,100 of them.

Defined results. Null and empty texts have no words; a null id counts as an
empty one; repeated rows count as often as they stand there; columns other than
``doc_id`` and ``text`` are not read; an empty table gives no rows. Ties in n go
to the smaller word in code-point order. A text of any length is one row: its
runs are one array of the task that reads it.
"""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumenseek.llm.common import ready, staged

#: Letters of a run, least code points and occurrences of a word, one deletion in so many hashes.
RUN, LEAST_CHARS, LEAST_N, DELETE_EVERY = r"[A-Za-zÀ-ÿ]+", 7, 2, 31
#: A form occurs at least so many times as often as its variant.
TIMES = 10
GRAM, PREFIX = 2, 3


def words(docs: DataFrame) -> DataFrame:
    """``word`` and ``n``: lower-cased runs, some with a character less, that occur often enough."""
    # Runs that are too short can't become words, and the longer ones are still maximal.
    runs = F.regexp_extract_all("text", F.lit(RUN.replace("+", f"{{{LEAST_CHARS},}}")), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.withColumn("run", F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DELETE_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = each.withColumn("h", hashed).select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return counted.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_N)


def gram_frequencies(known: DataFrame) -> dict[str, int]:
    """How many words have a bigram; bounded by the square of the alphabet."""
    place = F.sequence(F.lit(1), F.length("word") - (GRAM - 1))
    grams = F.array_distinct(F.transform(place, lambda i: F.substring("word", i, F.lit(GRAM))))
    rows = known.select(F.explode(grams).alias("gram")).groupBy("gram").count().collect()
    return {r["gram"]: r["count"] for r in rows}


def pivots(ranks: list[int], cost: list[int], prefix: list[int]) -> tuple[int, int]:
    """The two places of ``prefix`` (rising) that are ``GRAM`` apart or more and cost least together.

    ``cheapest`` is the best first pivot among those that end before the place looked at.
    """
    best, cheapest, waiting = None, None, 0
    for j in prefix:
        while prefix[waiting] <= j - GRAM:
            i = prefix[waiting]
            if cheapest is None or cost[ranks[i]] < cost[ranks[cheapest]]:
                cheapest = i
            waiting += 1
        if cheapest is not None:
            total = cost[ranks[cheapest]] + cost[ranks[j]]
            if best is None or total < best[0]:
                best = (total, cheapest, j)
    return best[1], best[2]


def with_grams(known: DataFrame) -> DataFrame:
    """Adds ``prefix`` (places), ``last`` (rank of its end in the order of bigrams) and pivots ``a`` and ``b``."""
    spark = known.sparkSession
    ready(spark)
    frequency = gram_frequencies(known)
    order = sorted(frequency, key=lambda g: (frequency[g], g))
    shared = spark.sparkContext.broadcast(({g: at for at, g in enumerate(order)}, [frequency[g] for g in order]))

    def cut(batches):
        rank, cost = shared.value
        for batch in batches:
            prefixes, lasts, a, b = [], [], [], []
            for word in batch.column(0).to_pylist():
                ranks = [rank[word[i:i + GRAM]] for i in range(len(word) - GRAM + 1)]
                last = sorted(ranks)[PREFIX - 1]
                prefix = [i for i, r in enumerate(ranks) if r <= last]
                left, right = pivots(ranks, cost, prefix)
                prefixes.append(prefix)
                lasts.append(last)
                a.append(left)
                b.append(right)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prefixes, pa.list_(pa.int32())), pa.array(lasts, pa.int32()),
                 pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["word", "n", "prefix", "last", "a", "b"])

    return known.select("word", "n").mapInArrow(cut, "word string, n bigint, prefix array<int>, last int, a int, b int")


def _keys(word: Column, place: Column, side: str, off: int = 0) -> list[Column]:
    """Keys of the bigram at ``place`` that stands ``off`` further right in a word that is ``off`` longer.

    One key for an edit in the half at the start, one for an edit in the half next to the bigram.
    """
    there = place + off
    half = F.shiftright(there, 1)
    size = F.length(word)
    same = [F.lit(side), size + off, there]
    after = F.xxhash64(F.lit("late"), *same, F.substring(word, half - off + 1, size))
    around = F.xxhash64(F.lit("early"), *same, F.substring(word, F.lit(1), half), F.substring(word, place + 1, size))
    return [after, around]


def near_pairs(known: DataFrame) -> DataFrame:
    """``x``, ``y`` (x < y), ``n_x``, ``n_y``: all pairs of words that one inserted, deleted or replaced character separates."""
    grams = staged(with_grams(known), "op12-grams")
    size, word, turned = F.length("word"), F.col("word"), F.reverse("word")
    # Seen from the other end, the left pivot is a right one.
    pivot_keys = [k for off in (-1, 0, 1) for k in (*_keys(word, F.col("b"), "right", off),
                                                    *_keys(turned, size - GRAM - F.col("a"), "left", off))]
    prefix_keys = F.flatten(F.transform("prefix", lambda p: F.array(
        *_keys(word, p, "right"), *_keys(turned, size - GRAM - p, "left"))))
    index = grams.select(F.explode(F.array(*pivot_keys)).alias("key"), word.alias("r"), F.col("n").alias("n_r"),
                         F.col("last").alias("last_r"))
    probes = grams.select(F.explode(F.array_distinct(prefix_keys)).alias("key"), word.alias("s"), F.col("n").alias("n_s"),
                          F.col("last").alias("last_s"))
    met = index.join(probes, "key").where((F.col("last_r") <= F.col("last_s")) & (F.col("r") != F.col("s"))
                                          & (F.levenshtein("r", "s", 1) == 1))
    first = F.col("r") < F.col("s")
    return met.select(F.least("r", "s").alias("x"), F.greatest("r", "s").alias("y"),
                      F.when(first, F.col("n_r")).otherwise(F.col("n_s")).alias("n_x"),
                      F.when(first, F.col("n_s")).otherwise(F.col("n_r")).alias("n_y")).distinct()


def forms(known: DataFrame) -> DataFrame:
    """``word``, ``n``, ``n_near``, and ``form`` with ``form_n`` where a near word is frequent enough."""
    sides = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("m")),
                    F.struct(F.col("y").alias("word"), F.col("x").alias("other"), F.col("n_x").alias("m")))
    near = near_pairs(known).select(F.explode(sides).alias("p")).select("p.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("top"))
    found = known.join(near, "word", "left")
    enough = -F.col("top.less") >= TIMES * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                        F.when(enough, F.col("top.other")).alias("form"), F.when(enough, -F.col("top.less")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``word`` and ``root`` of the words that have a form, by doubling: forms of forms until nothing moves.

    Every step multiplies n by ten at least, so a chain has fewer than 19 steps and five rounds end it.
    """
    at = staged(formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = staged(at.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"),
                                                               F.col("beyond").isNotNull().alias("moved")), "op12-roots")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def op12_variants(docs: DataFrame) -> DataFrame:
    """Every word with its count, its near words, its form and the root that the forms lead to.

    No words at all give no rows; see the module for nulls, ties and the other cases.
    """
    known = staged(words(docs), "op12-words")
    formed = staged(forms(known), "op12-forms")
    root = F.coalesce("root", "word").alias("root")
    return formed.join(roots(formed), "word", "left").select("word", "form", root, "n", "n_near", "form_n")
