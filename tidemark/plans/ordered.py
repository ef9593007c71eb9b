"""Whole-table order without a single task: ranges, and what carries over from one range to the next.

A window over a whole table would put all rows in one partition. Here rows are dealt by ranges of the key and
written to the shared folder with the number of their range; windows run within ranges, and a table of one row
for each range carries counts, sums and edge keys across. Only that table passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Column that holds the number of the range.
RANGE = "_range"


def by_ranges(df: DataFrame, *keys: str | Column, ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: ranges are in the order of the keys; equal keys share one."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id())
    return materialize(dealt, "ranges")[0]


def carried(ranged: DataFrame, total: Column, initial=0, name: str = "_carry") -> DataFrame:
    """``(_range, _carry)``: sum of ``total`` over all earlier ranges."""
    order = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy(RANGE).agg(total.alias("_total"))
    return sums.select(RANGE, F.coalesce(F.sum("_total").over(order), F.lit(initial)).alias(name))


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before in ``order``."""
    ranged = by_ranges(df, *order)
    before = carried(ranged, F.sum(value))
    own = Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(before), RANGE)  # a row for each range
    return out.withColumn(name, (F.col("_carry") + F.coalesce(F.sum(value).over(own), F.lit(0))).cast("long")).drop(RANGE, "_carry")


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the number of rows before each."""
    return running(df, order, F.lit(1), name)


def neighbours(df: DataFrame, key: str, prev: str = "prev", following: str = "next") -> DataFrame:
    """``df`` with the keys before and after each row's; keys are unique."""
    ranged = by_ranges(df, key)
    edges = ranged.groupBy(RANGE).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    order = Window.orderBy(RANGE)  # a row for each range that has any
    edges = edges.select(RANGE, F.lag("_hi").over(order).alias("_hi_before"), F.lead("_lo").over(order).alias("_lo_after"))
    own = Window.partitionBy(RANGE).orderBy(key)
    out = ranged.join(F.broadcast(edges), RANGE)
    return out.withColumns({prev: F.coalesce(F.lag(key).over(own), "_hi_before"), following: F.coalesce(F.lead(key).over(own), "_lo_after")}).drop(RANGE, "_hi_before", "_lo_after")


def lower_bounds(df: DataFrame, key: str, probes: DataFrame, probe: str) -> DataFrame:
    """``probes`` with ``found``: the smallest key of ``df`` that is not below each probe, null if there is none."""
    keys = df.select(F.col(key).alias("_k"), F.lit(1).alias("_kind"))
    asked = probes.select(F.col(probe).alias("_k"), F.lit(0).alias("_kind")).distinct()
    ranged = by_ranges(keys.unionByName(asked), "_k")
    is_key = F.when(F.col("_kind") == 1, F.col("_k"))
    order = Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    later = ranged.groupBy(RANGE).agg(F.min(is_key).alias("_lo")).select(RANGE, F.min("_lo").over(order).alias("_after"))
    own = Window.partitionBy(RANGE).orderBy(F.desc("_k"))  # from the end, so that the frame only grows
    found = ranged.join(F.broadcast(later), RANGE).withColumn("found", F.coalesce(F.min(is_key).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "_after"))
    found = found.where("_kind = 0").select(F.col("_k").alias(probe), "found")
    return probes.join(found, probe, "left")
