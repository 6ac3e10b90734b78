"""Array helpers shared by the per-file operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Running sums go block by block; 16 measured best on files of usual length.
BLOCK = 16


def _appended_sums(values: Column) -> Column:
    """Running sums by appending, for the short array of block totals."""
    def step(sums: Column, value: Column) -> Column:
        return F.concat(sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + value))

    return F.aggregate(values, F.array().cast("array<int>"), step)


def _short_sums(block: Column) -> Column:
    return F.transform(block, lambda _, i: F.aggregate(
        F.slice(block, F.lit(1), i + 1), F.lit(0), lambda total, v: total + v))


def running_sum(values: Column, levels: int = 2) -> Column:
    """Inclusive running sums of an int array.

    Sums are formed inside short blocks and shifted by the sum of the blocks
    before, which is found the same way; appending over the whole array would
    copy it once per element.
    """
    def block_sums(bound: Column) -> Column:
        last = F.greatest(F.floor((F.size(bound) - 1) / BLOCK).cast("int"), F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: let(
            part(bound, k * BLOCK, F.least(F.size(bound) - k * BLOCK, F.lit(BLOCK))), _short_sums))

    def shifted(sums: Column) -> Column:
        totals = F.transform(sums, lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)))
        return let(running_sum(totals, levels - 1) if levels > 1 else _appended_sums(totals), lambda ends: F.flatten(F.zip_with(sums, shifted_back(ends), lambda s, before: (
            F.transform(s, lambda v: v + F.coalesce(before, F.lit(0)))))))

    return let(let(values, block_sums), shifted)


def part(values: Column, start: Column, length: Column | int) -> Column:
    """``length`` elements from 0-based ``start``, in time proportional to ``length``.

    ``values`` must be a column or a bound variable, not an expression: it is
    looked up once per element.

    The built-in slice walks the whole array on every call, which is quadratic
    when an array is cut into many parts.
    """
    rows = F.when(F.lit(length) > 0, F.sequence(start, start + length - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(rows, lambda i: F.get(values, i))


def shifted_back(values: Column) -> Column:
    """Every element's predecessor; NULL for the first. As for ``part``, an expression is to be bound first."""
    return F.slice(F.concat(F.array(F.lit(None)), values), 1, F.size(values))


def shifted_on(values: Column) -> Column:
    """Every element's successor; NULL for the last. As for ``part``, an expression is to be bound first."""
    return F.slice(F.concat(values, F.array(F.lit(None))), 2, F.size(values))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    An expression used inside a lambda is evaluated again for every element;
    bound to a lambda variable of its own it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
