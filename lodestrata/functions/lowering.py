"""Expressions whose meaning in the dialect differs from Spark's own, as compositions of built-in columns."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Integer division that truncates; division by zero is an error."""
    return F.call_function("div", a, b)


def to_int8(x: Column) -> Column:
    """Number to 64-bit integer, rounding halves away from zero; out of range is an error."""
    return F.round(x, 0).cast("bigint")


def exact_sum(x: Column) -> Column:
    """Sum of integers without overflow at 64 bits; null without values."""
    return F.sum(x.cast("decimal(38,0)"))


def exact_avg(x: Column, scale: int = 6) -> Column:
    """Average of integers as a decimal, not as a double."""
    return F.avg(x.cast("decimal(28,0)")).cast(f"decimal(38,{scale})")


def lower_ascii(x: Column) -> Column:
    """Lower case of the letters A to Z alone."""
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def upper_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_lowercase, string.ascii_uppercase)


def trunc_utc(unit: str, ts: Column) -> Column:
    """Start of the day, month or year; the session's time zone must be UTC."""
    if unit not in ("day", "month", "year"):
        raise ValueError(f"no such unit: {unit}")
    return F.date_trunc(unit, ts)


def first_nulls_last(*columns: str | Column) -> list[Column]:
    """Ascending order with nulls last, as the dialect orders by default."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns]


def filtered_over(agg, x: Column, keep: Column, window: WindowSpec) -> Column:
    """agg(x) FILTER (WHERE keep) OVER window, which Spark refuses: rows that aren't kept count as null."""
    return agg(F.when(keep, x)).over(window)


def bool_extreme(x: Column, most: bool) -> Column:
    """min or max of booleans."""
    return F.bool_or(x) if most else F.bool_and(x)


def with_in_truth(left: DataFrame, key: str, right: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the three-valued truth of `key IN (SELECT column FROM right)` as a projected column.

    True on a match; null where the key is null or the set holds a null, unless the set is empty; else false. The set's size
    and null count are one row.
    """
    there = right.select(F.col(column).alias("_set"))
    totals = there.agg(F.count("*").alias("_n"), F.count_if(F.col("_set").isNull()).alias("_nulls"))
    hits = there.dropna().distinct()
    joined = left.join(hits, left[key] == hits["_set"], "left").crossJoin(F.broadcast(totals))
    truth = F.when(F.col("_n") == 0, F.lit(False)).when(F.col("_set").isNotNull(), F.lit(True)).when(F.col(key).isNull() | (F.col("_nulls") > 0), F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return joined.withColumn(name, truth).drop("_set", "_n", "_nulls")
