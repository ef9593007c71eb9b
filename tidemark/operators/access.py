"""Point access, ranges and prefixes over a table with an orderable key column.

A key column may be BINARY, STRING or a number: Spark orders all of them as the store does (bytes unsigned,
shorter first). Bounds are plain comparisons, so they reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError
from tidemark.functions.order import successor

#: A side is broadcast only if it was seen to have no more rows than this.
BROADCAST_ROWS = 100_000


def if_small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if counting shows at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def get(df: DataFrame, key: str, k) -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == F.lit(k))


def at(df: DataFrame, key: str, k):
    """The row of a key; raises NotFound."""
    row = get(df, key, k).first()
    if row is None:
        raise StoreError(Code.NOT_FOUND, repr(k))
    return row


def contains(df: DataFrame, key: str, k) -> bool:
    return not get(df, key, k).select(F.lit(1)).isEmpty()


def between(df: DataFrame, key: str, lo=None, hi=None) -> DataFrame:
    """Rows with lo <= key < hi; None is unbounded."""
    if lo is not None:
        df = df.where(F.col(key) >= F.lit(lo))
    if hi is not None:
        df = df.where(F.col(key) < F.lit(hi))
    return df


def from_(df: DataFrame, key: str, lo) -> DataFrame:
    return between(df, key, lo)


def upto(df: DataFrame, key: str, hi) -> DataFrame:
    """Rows below ``hi``; an empty bound is below every key, so nothing is."""
    return between(df, key, None, hi)


def scan(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """All rows in key order."""
    return df.orderBy(F.desc(key) if descending else F.asc(key))


def prefix(df: DataFrame, key: str, p: str | bytes) -> DataFrame:
    """Rows whose key starts with ``p``, as a range where p has a successor."""
    raw = p.encode() if isinstance(p, str) else p
    after = successor(raw)
    if isinstance(p, str):
        return df.where(F.col(key).startswith(p))  # Spark pushes a prefix of a string down as such
    ranged = between(df, key, raw, after)
    return ranged if after is not None else ranged.where(F.col(key).startswith(F.lit(raw)))


def suffix(df: DataFrame, key: str, s: str | bytes) -> DataFrame:
    """Rows whose key ends with ``s``: a prefix scan in reversed-byte order."""
    return df.where(F.col(key).endswith(F.lit(s)))


def starts_with(c: Column, p: bytes) -> Column:
    return c.startswith(F.lit(p))


def ends_with(c: Column, s: bytes) -> Column:
    return c.endswith(F.lit(s))


def subspan(c: Column, offset: int, n: int | None = None) -> Column:
    """Part of a value, clamped to its ends."""
    return F.substring(c, F.lit(offset + 1), F.lit((1 << 31) - 1 if n is None else n))


def keys_only(df: DataFrame, key: str) -> DataFrame:
    """Keys alone; the scan then leaves the values unread."""
    return df.select(key)


def visit(df: DataFrame, key: str, p: str | bytes, most: int | None = None) -> DataFrame:
    """Keys with a prefix, in order; at most ``most`` of them."""
    found = scan(keys_only(prefix(df, key, p), key), key)
    return found if most is None else found.limit(most)


def find_many(df: DataFrame, key: str, probes: DataFrame, pos: str = "pos") -> DataFrame:
    """For each probe ``(pos, key)`` the row of its key and ``found``, in the order of pos; misses keep nulls."""
    rows = df.withColumn("_hit", F.lit(True))
    wanted = rows.join(if_small(probes.select(key).distinct()), key, "left_semi")
    joined = probes.join(wanted, key, "left")
    return joined.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit").orderBy(pos)
