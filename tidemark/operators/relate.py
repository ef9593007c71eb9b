"""The joins inside the engine's operations: index look-ups, overlays, conflicts, re-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.access import if_small


def by_index(index: DataFrame, base: DataFrame, key: str, *order: str) -> DataFrame:
    """Base rows of index entries in index order; an entry without a row is dropped."""
    return index.join(base, key).orderBy(*order)


def overlay(base: DataFrame, writes: DataFrame, key: str, erased: str) -> DataFrame:
    """Snapshot under a transaction's writes (one for each key): writes win, those with ``erased`` hide the key."""
    values = [c for c in base.columns if c != key]
    new = writes.select(key, *(F.col(c).alias(f"_n_{c}") for c in values), F.col(erased).alias("_gone"), F.lit(True).alias("_there"))
    both = base.join(new, key, "full")
    shown = both.where(F.col("_there").isNull() | ~F.col("_gone"))
    return shown.select(key, *(F.when(F.col("_there"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def conflicts(touched: DataFrame, log: DataFrame) -> DataFrame:
    """Transactions that must retry: ``touched(txn, snapshot, db, key)`` against ``log(commit_txn, db, key, unknown)``.

    A commit after the snapshot conflicts if it wrote the same key, if either side names a whole database (null
    key: a scan, or a cleared one), or if what it wrote is unknown. Only the newest write of each key and of each
    database decides, so both are aggregated before the join: a touched row meets one row at most.
    """
    newer = F.col("commit_txn") > F.col("snapshot")
    writes = log.where(~F.col("unknown"))
    newest = F.max("commit_txn").alias("commit_txn")
    points = touched.where("key is not null").join(writes.where("key is not null").groupBy("db", "key").agg(newest), ["db", "key"]).where(newer)
    scans = touched.where("key is null").select("txn", "snapshot", "db").join(writes.groupBy("db").agg(newest), "db").where(newer)
    cleared = touched.where("key is not null").select("txn", "snapshot", "db").join(writes.where("key is null").groupBy("db").agg(newest), "db").where(newer)
    last_unknown = log.where("unknown").agg(F.max("commit_txn").alias("commit_txn"))  # one row
    any_of = touched.select("txn", "snapshot").join(F.broadcast(last_unknown), newer)
    return points.select("txn").union(scans.select("txn")).union(cleared.select("txn")).union(any_of.select("txn")).distinct()


def keys_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def still_valid(candidates: DataFrame, leases: DataFrame) -> DataFrame:
    """Candidates whose lease is unchanged: same message, token and deadline."""
    return candidates.join(leases.select("seq", "token", "lease_deadline_ns"), ["seq", "token", "lease_deadline_ns"])


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``(key, side)``."""
    left = a.select(key).join(b.select(key), key, "left_anti").select(key, F.lit("left").alias("side"))
    return left.union(b.select(key).join(a.select(key), key, "left_anti").select(key, F.lit("right").alias("side")))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new snapshot that the old one has not."""
    return new.exceptAll(old)


def probe(base: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Batched probe that keeps misses."""
    return if_small(probes).join(base, key, "left")
