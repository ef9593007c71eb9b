"""Window-shaped computations: order checks, runs, layouts, contiguity, and budgets.

Those over a whole table use ranges (``plans.ordered``); those within a partition column use plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import ordered

BLOCK = 512


def disorder(df: DataFrame, key: str, order: str) -> DataFrame:
    """``bad``: neighbours in ``order`` whose keys do not ascend strictly."""
    from tidemark.operators.mutate import append_violations

    return append_violations(df, key, order).select(F.col("violations").alias("bad"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def runs(df: DataFrame, part: str, order: str, kind: str) -> DataFrame:
    """Runs of equal ``kind`` in order, within each ``part``: ``(part, kind, first, last, n)``."""
    w = Window.partitionBy(part).orderBy(order)
    starts = F.when(F.lag(kind).over(w).eqNullSafe(F.col(kind)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(w))
    return numbered.groupBy(part, kind, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def padded(size: Column) -> Column:
    return (F.ceil(size / BLOCK) * BLOCK).cast("long")


def archive_layout(members: DataFrame, order: str, size: str) -> DataFrame:
    """Members with ``offset``: where each payload begins when all are appended in ``order`` (a header block before each)."""
    out = ordered.running(members, [order], F.lit(BLOCK) + padded(F.col(size)), "_before")
    return out.withColumn("offset", (F.col("_before") + BLOCK).cast("long")).drop("_before")


def merged_spans(spans: DataFrame, part: str, start: str, end: str, gap: int = 4096) -> DataFrame:
    """Spans at most ``gap`` apart merged, within each ``part``: ``(part, lo, hi, n)``."""
    w = Window.partitionBy(part).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    return numbered.groupBy(part, "_run").agg(F.min(start).alias("lo"), F.max(end).alias("hi"), F.count(F.lit(1)).alias("n")).drop("_run")


def contiguous_tail(segments: DataFrame, part: str, first: str, last: str) -> DataFrame:
    """The newest segments that join on to each other without a gap, within each ``part``: ``(part, oldest, newest, n)``."""
    w = Window.partitionBy(part).orderBy(first)
    broken = F.when(F.lag(last).over(w).isNull() | (F.col(first) == F.lag(last).over(w) + 1), 0).otherwise(1)
    later = Window.partitionBy(part).orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, -1)
    kept = segments.withColumn("_broken", broken).withColumn("_after", F.coalesce(F.sum("_broken").over(later), F.lit(0))).where("_after = 0")
    return kept.groupBy(part).agg(F.min(first).alias("oldest"), F.max(last).alias("newest"), F.count(F.lit(1)).alias("n"))


def numbered(batch: DataFrame, order: list[str], base: int, name: str = "seq") -> DataFrame:
    """Consecutive numbers from ``base`` on in the given order."""
    return ordered.ranked(batch, order, "_n").withColumn(name, (F.col("_n") + base).cast("long")).drop("_n")


def newest_of(log: DataFrame, page: str, txn: str) -> DataFrame:
    """Of each page the last transaction that wrote it."""
    return log.groupBy(page).agg(F.max(txn).alias(txn))


def tree_stats(df: DataFrame, size: Column, *by: Column | str) -> DataFrame:
    """Entries, bytes and bytes an entry, for each group."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.sum(size.cast("long")).alias("bytes"))
    return out.withColumn("bytes_per_entry", F.floor(F.col("bytes") / F.col("entries")).cast("long"))


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("readers"))
