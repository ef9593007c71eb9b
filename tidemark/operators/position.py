"""Positions in key order: ends, seeks, neighbours, ranks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.access import between
from tidemark.plans import ordered


def first(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    """The n smallest rows: top-n in each task, merged; no full sort."""
    return df.orderBy(key).limit(n)


def last(df: DataFrame, key: str, n: int = 1) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(n)


def bounds(df: DataFrame, key: str) -> DataFrame:
    """One row: the smallest key ``lo`` and the largest ``hi``, null if there is none."""
    return df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))


def seek(df: DataFrame, key: str, k) -> DataFrame:
    """The first row with a key not below k."""
    return first(between(df, key, k), key)


def next_of(df: DataFrame, key: str, k) -> DataFrame:
    return first(df.where(F.col(key) > F.lit(k)), key)


def prev_of(df: DataFrame, key: str, k) -> DataFrame:
    return last(between(df, key, None, k), key)


def page_after(df: DataFrame, key: str, k, n: int) -> DataFrame:
    """Keyset pagination: the next n rows after a key that may have been erased meanwhile."""
    rows = df if k is None else df.where(F.col(key) > F.lit(k))
    return first(rows, key, n)


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """All rows with the keys before and after them."""
    return ordered.neighbours(df, key)


def seek_many(df: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    return ordered.lower_bounds(df, key, probes, probe)


def rank(df: DataFrame, key: str, k) -> DataFrame:
    """How many rows lie before k."""
    return between(df, key, None, k).agg(F.count(F.lit(1)).alias("rank"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("entries"))


def count_range(df: DataFrame, key: str, lo=None, hi=None) -> DataFrame:
    """Rows in [lo, hi); an empty bound counts as none, and hi <= lo gives 0."""
    lo, hi = (None if b in ("", b"") else b for b in (lo, hi))
    return between(df, key, lo, hi).agg(F.count(F.lit(1)).alias("entries"))


def count_ranges(df: DataFrame, key: str, ranges: DataFrame) -> DataFrame:
    """``ranges(id, lo, hi)`` with entries: ranks of all bounds in one pass over ranges of the table."""
    bounds = ranges.select(F.explode(F.array("lo", "hi")).alias(key)).where(F.col(key).isNotNull()).distinct()
    rows = df.select(key, F.lit(1).alias("_n")).unionByName(bounds.select(key, F.lit(0).alias("_n")))
    before = ordered.running(rows, [key, "_n"], F.col("_n"), "_before").where("_n = 0").select(key, "_before")
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    lo = before.select(F.col(key).alias("lo"), F.col("_before").alias("_lo"))
    hi = before.select(F.col(key).alias("hi"), F.col("_before").alias("_hi"))
    out = ranges.join(lo, "lo", "left").join(hi, "hi", "left").join(F.broadcast(total))  # total is one row
    entries = F.coalesce("_hi", "_all") - F.coalesce("_lo", F.lit(0))
    return out.select("id", "lo", "hi", F.greatest(entries, F.lit(0)).cast("long").alias("entries"))


def skip(df: DataFrame, key: str, n: int) -> DataFrame:
    """The row n places after the first, or none: counts of ranges find its range, only that range is sorted."""
    ranged = ordered.by_ranges(df, key)
    sizes = sorted((r[ordered.RANGE], r["count"]) for r in ranged.groupBy(ordered.RANGE).count().collect())  # a row for each range
    for number, size in sizes:
        if n < size:
            return ranged.where(F.col(ordered.RANGE) == number).drop(ordered.RANGE).orderBy(key).offset(n).limit(1)
        n -= size
    return df.limit(0)


def ranks(df: DataFrame, key: str) -> DataFrame:
    """All rows with the number of rows before them."""
    return ordered.ranked(df, [key])
