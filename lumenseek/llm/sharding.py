"""Sharding by proportional stratified interleaving.

Rows are ordered within their source by a seeded hash; row number r of n gets the
fractional rank (r + 1/2) / n. All rows sorted by fractional rank are cut into
shards of equal row counts, so every shard holds the sources in the proportions
of the whole.

No window sees a source or the whole table. Hashes and fractional ranks are
spread evenly, so equal ranges of them hold about ``BUCKET_ROWS`` rows each; the
counts of the ranges give each its offset, and rows are numbered inside a range.
Equal rows are counted in the map tasks first and numbered as one, so a row that
repeats any number of times cannot fill a range.

Null sources are one source of their own. Null texts have size 1. An empty table
has no shards.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from lumenseek.llm.common import staged

SHARDS = 8
#: Rows of a range, on average. One window task numbers one range or several.
BUCKET_ROWS = 4096


def _offset(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """Rows in the ranges before each; ``counts`` has one row per range."""
    w = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


ROW = ["doc_id", "source", "size", "text_crc32"]


def _row() -> list[Column]:
    """What a row is known by when it is placed."""
    text = F.coalesce("text", F.lit(""))
    return [F.col("doc_id"), F.col("source"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")]


def _assigned(docs: DataFrame, shards: int, seed: int) -> DataFrame:
    """``ROW``, ``copy`` (number among equal rows), ``shard`` and ``slot`` of every row."""
    row = ROW
    rows = staged(docs.select(*_row()).groupBy(*row).agg(F.count(F.lit(1)).alias("m"))
                  .withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), 1)), "shard-rows")
    total = rows.agg(F.sum("m")).first()[0] or 0
    stratum = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    rows = rows.withColumn("stratum", stratum)
    sources = rows.groupBy("stratum").agg(F.sum("m").alias("rows"), F.count(F.lit(1)).alias("different"))
    # Range of the hash: its upper 31 bits scaled to the number of ranges of the source.
    ranged = rows.join(sources, "stratum").withColumn("range", F.shiftright(F.shiftright("h", 32) * F.ceil(
        F.col("different") / BUCKET_ROWS), 31))
    # Else the windows would take the exchange of the join, and a hot source would be one task.
    ranged = ranged.repartition("stratum", "range")
    counts = ranged.groupBy("stratum", "range").agg(F.sum("m").alias("n"))
    inside = Window.partitionBy("stratum", "range").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = (ranged.withColumn("rank", F.sum("m").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
              .join(_offset(counts, ["stratum"], "range"), ["stratum", "range"])
              .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
              .withColumn("rank", F.col("rank") + F.col("before") + F.col("copy"))
              .withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("rows"))))
    ranges = max(1, -(-total // BUCKET_ROWS))
    ranked = staged(ranked.select(*row, "copy", "stratum", "rank", "fraction", F.floor(F.col("fraction") * ranges).alias("part")),
                    "shard-ranked")
    order = Window.partitionBy("part").orderBy("fraction", "stratum", "rank")
    parts = _offset(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part")
    placed = (ranked.withColumn("place", F.row_number().over(order) - 1).join(parts, "part")
              .withColumn("place", F.col("place") + F.col("before"))
              .withColumn("shard", F.floor(F.col("place") * shards / F.lit(max(total, 1))).cast("int")))
    # place * shards stays far below 2^53, so the quotient's floor is exact.
    first = F.ceil(F.col("shard").cast("bigint") * total / F.lit(shards))
    return placed.select(*row, "copy", "shard", (F.col("place") - first).cast("bigint").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row."""
    return _assigned(docs, shards, seed).drop("copy")


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Every row of ``docs`` with all its columns, and its shard and slot.

    Equal rows are one row with a count in the map tasks and get their places by
    number; rows that differ only in what they are not placed by share the
    numbers. Columns of ``docs`` named ``shard`` or ``slot`` give way to the new ones.
    """
    columns = [c for c in docs.columns if c not in ("shard", "slot")]
    body, m, first, *key = (f"{name}_{uuid.uuid4().hex}" for name in ("body", "m", "first", *ROW))
    known = docs.select(F.struct(*columns).alias(body), *[c.alias(k) for c, k in zip(_row(), key)])
    known = known.groupBy(body, *key).agg(F.count(F.lit(1)).alias(m))
    before = Window.partitionBy(*key).orderBy(F.xxhash64(body), body).rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn(first, F.coalesce(F.sum(m).over(before), F.lit(0)))
    placed = _assigned(docs, shards, seed)
    same = [known[k].eqNullSafe(placed[c]) for k, c in zip(key, ROW)]
    mine = (placed["copy"] >= known[first]) & (placed["copy"] < known[first] + known[m])
    found = placed.join(known, functools.reduce(lambda x, y: x & y, [*same, mine]))
    return found.select(*[F.col(body)[c].alias(c) for c in columns], placed["shard"], placed["slot"])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 0) -> None:
    """Write the rows as Parquet, one folder per shard, ordered by slot from file to file.

    Ranges of shard and slot are the tasks, so a shard is written by as many as the shuffle has partitions for it.
    """
    out = sharded(docs, shards, seed)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def manifest(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """Shard and slot of every row by the law of equal counts; see the module for nulls, repeats and empty tables."""
    out = assign(docs, shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "source")
