"""Scalar expressions: bins, outlier degrees, softmax, set predicates. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bin of a numeric null or NaN.
NO_VALUE = -1


def number(col: str | Column) -> Column:
    """A numeric column as double, NaN as null."""
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.when(~F.isnan(v), v)


def uniform_bin(col: str | Column, low: float | None, high: float | None, bins: int) -> Column:
    """``trunc((v - low) / (high - low) * bins)`` held to ``0 .. bins - 1``; 0 for a constant feature, -1 for no value."""
    v = number(col)
    if low is None or high is None:
        inside = F.lit(0)
    elif high == low:
        inside = F.lit(0)
    else:
        share = (v - F.lit(float(low))) / F.lit(float(high) - float(low))
        inside = F.least(F.greatest(F.floor(F.greatest(F.least(share, F.lit(2.0)), F.lit(-1.0)) * F.lit(float(bins))).cast("double"), F.lit(0.0)), F.lit(float(bins - 1))).cast("int")
    return F.when(v.isNull(), F.lit(NO_VALUE)).otherwise(inside).cast("int")


def category(col: str | Column) -> Column:
    """A categorical value as a key that is never null: ``n`` for null, else ``v`` and the value."""
    v = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(v.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), v))


def outlier_degree(size: Column) -> Column:
    """``exp(-n^2)`` of a closure size; an absent closure has size 0 and degree 1."""
    return F.exp(-F.pow(F.coalesce(size, F.lit(0)).cast("double"), F.lit(2.0)))


def safe_bin(bin_: Column, bins: int) -> Column:
    """A bin held to ``0 .. bins - 1``."""
    return F.least(F.greatest(bin_, F.lit(0)), F.lit(bins - 1))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(scores: Column) -> Column:
    """Stable softmax of an array."""
    shared = lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(e, lambda v: v / t))
    return once(scores, lambda s: once(F.array_max(s), lambda m: once(F.transform(s, lambda v: F.exp(v - m)), shared)))


def softmax_cross_entropy(probabilities: Column, label: Column) -> Column:
    """``-log`` of the label's probability, for use under ``avg``."""
    return -F.log(F.element_at(probabilities, label.cast("int") + 1))


def argmax(values: Column) -> Column:
    """The index of the largest value; the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def weighted_sum(degrees: Column, weights: Sequence[float]) -> Column:
    """The dot product of an array column and literal weights."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(degrees, w, lambda d, x: d * x), F.lit(0.0), lambda a, x: a + x)


def intersect(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def proper_subset_of(a: Column, b: Column) -> Column:
    return subset_of(a, b) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def add(a: Column, element: Column) -> Column:
    return F.sort_array(F.array_union(a, F.array(element)))


def contains(a: Column, element: Column) -> Column:
    return F.array_contains(a, element)


def set_size(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def words(a: Column, width: int = 64) -> Column:
    """A set of small integers as an array of ``width``-bit words, lowest first (for storage or a hex dump)."""
    last = F.coalesce(F.array_max(a), F.lit(-1))
    index = F.when(last < 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.floor(F.greatest(last, F.lit(0)) / width).cast("int")))
    return F.transform(index, lambda k: F.aggregate(F.filter(F.array_distinct(a), lambda e: F.floor(e / width) == k), F.lit(0).cast("bigint"), lambda acc, e: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(e, F.lit(width)).cast("int")))))


def hex_dump(a: Column) -> Column:
    """Hexadecimal digits of the words, highest word first."""
    return F.array_join(F.transform(F.reverse(words(a)), lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")
