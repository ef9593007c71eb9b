"""Connected components of a link table by alternating large and small stars.

Each round replaces links by links to smaller vertices until only stars around the smallest vertex of each
component are left. All links stay in DataFrames; a round's links are written to the shared folder, so that
lineage stays short and a lost executor costs one round. Per vertex only a minimum is kept, never a list of
its neighbours, so a hub with a third of all links is pre-aggregated before the shuffle. The minima are written
too before links meet them: both sides of that join are then plain exchanges, and Spark splits a hub's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import drop_folder, materialize


def _minima(rows: DataFrame, own: list[str]):
    """``(a, m)``: the smallest b of each a, written; its folder is noted in ``own``."""
    found, uri = materialize(rows, "minima")
    own.append(uri)
    return found


def _large_star(links: DataFrame, own: list[str]) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minima(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), own)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame, own: list[str]) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _minima(down.groupBy("a").agg(F.min("b").alias("m")), own)
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every vertex is either the end of one link or a centre; links point to smaller vertices."""
    ends = links.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    centres = links.groupBy(F.col("b").alias("v")).agg(F.lit(0).alias("up"), F.lit(1).alias("down"))
    return ends.union(centres).groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` to ``(vertex, component)`` with the smallest vertex of each component as its name.

    Vertices without links have no row. Self-links, repeated links and both directions are allowed; rows with
    a null end are ignored. An empty table gives an empty one.
    """
    spark = links.sparkSession
    now, uri = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(now):
        own = [uri]
        large, large_uri = materialize(_large_star(now, own), "links")
        own.append(large_uri)
        now, uri = materialize(_small_star(large, own), "links")
        for folder in own:
            drop_folder(spark, folder)
    roots = now.select(F.col("b").alias("vertex")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(roots.select("vertex", F.col("vertex").alias("component")))
