"""Mutations as merges: single kinds as joins, ordered batches of mixed operations as a fold.

Presence is a flag of its own: an empty or null value is a value. Batches of one kind hold a key once; where a
batch may repeat keys, :func:`last_writers` or :func:`fold` comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError
from tidemark.plans import ordered

#: Operations that one partial fold gathers for a key, at most.
CHUNK = 4096
OPS = ("upsert", "insert_unique", "update_only", "erase")


def _values(df: DataFrame, key: str) -> list[str]:
    return [c for c in df.columns if c != key]


def _marked(df: DataFrame, key: str, tag: str) -> DataFrame:
    return df.select(key, *(F.col(c).alias(f"{tag}{c}") for c in _values(df, key)), F.lit(True).alias(f"{tag}there"))


def upsert(base: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Base rows, replaced or joined by those of the batch (same columns)."""
    both = _marked(base, key, "_b_").join(_marked(batch, key, "_n_"), key, "full")
    return both.select(key, *(F.when(F.col("_n_there"), F.col(f"_n_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in _values(base, key)))


def insert_unique(base: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The merged table, and the rows that were refused because their key is there."""
    return base.unionByName(batch.join(base.select(key), key, "left_anti")), batch.join(base.select(key), key, "left_semi")


def update_only(base: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The merged table, and the rows that were refused because their key is not there."""
    both = _marked(base, key, "_b_").join(_marked(batch, key, "_n_"), key, "left")
    merged = both.select(key, *(F.when(F.col("_n_there"), F.col(f"_n_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in _values(base, key)))
    return merged, batch.join(base.select(key), key, "left_anti")


def erase(base: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table without the keys, and the keys that were there."""
    return base.join(keys.select(key), key, "left_anti"), keys.select(key).join(base.select(key), key, "left_semi")


def erase_where(base: DataFrame, condition: Column) -> DataFrame:
    """Erase while iterating: rows for which the condition isn't true stay."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def append_violations(batch: DataFrame, key: str, order: str, floor=None) -> DataFrame:
    """``violations``: rows of a bulk load whose key is not above the one before it in ``order`` (or above ``floor``)."""
    ranged = ordered.by_ranges(batch.select(key, order), order)
    edges = ranged.groupBy(ordered.RANGE).agg(F.max_by(key, order).alias("_last"))
    by = Window.orderBy(ordered.RANGE)  # a row for each range
    edges = edges.select(ordered.RANGE, F.lag("_last").over(by).alias("_before"))
    own = Window.partitionBy(ordered.RANGE).orderBy(order)
    before = F.coalesce(F.lag(key).over(own), F.col("_before"), F.lit(floor)) if floor is not None else F.coalesce(F.lag(key).over(own), F.col("_before"))
    checked = ranged.join(F.broadcast(edges), ordered.RANGE).withColumn("_bad", before.isNotNull() & (F.col(key) <= before))
    return checked.agg(F.coalesce(F.sum(F.col("_bad").cast("long")), F.lit(0).cast("long")).alias("violations"))


def check_append(batch: DataFrame, key: str, order: str, floor=None) -> None:
    n = append_violations(batch, key, order, floor).first()[0]
    if n:
        raise StoreError(Code.INVALID_ARGUMENT, f"{n} keys are not above the one before")


def last_writers(ops: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row that is last in ``order``: what is left of a batch of upserts and erases.

    The rank limit is applied in each task before the shuffle, so a hot key sends a row for each task.
    """
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return ops.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


# An operation, or a run of them, is a function of whether the key is there, and of its value if so. It is kept as
# what becomes of an absent key (a: present?, av: value) and of a present one (p: present?, k: old value kept?, pv).
def _as_function(op: Column, value: Column) -> Column:
    puts_absent = op.isin("upsert", "insert_unique")
    keeps = op == "insert_unique"
    return F.struct(
        puts_absent.alias("a"),
        F.when(puts_absent, value).alias("av"),
        (op != "erase").alias("p"),
        keeps.alias("k"),
        F.when(op.isin("upsert", "update_only"), value).alias("pv"),
    )


def _after(f: Column, g: Column) -> Column:
    """First f, then g."""
    return F.struct(
        F.when(f["a"], g["p"]).otherwise(g["a"]).alias("a"),
        F.when(f["a"], F.when(g["k"], f["av"]).otherwise(g["pv"])).otherwise(g["av"]).alias("av"),
        F.when(f["p"], g["p"]).otherwise(g["a"]).alias("p"),
        (f["k"] & g["k"] & f["p"]).alias("k"),
        F.when(f["p"], F.when(g["k"], f["pv"]).otherwise(g["pv"])).otherwise(g["av"]).alias("pv"),
    )


def _composed(functions: Column) -> Column:
    """One function from an array of them in order."""
    return F.reduce(F.slice(functions, F.lit(2), F.size(functions)), F.get(functions, F.lit(0)), _after)


def fold(base: DataFrame, ops: DataFrame, key: str, value: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """``base(key, value)`` after ``ops(seq, op, key, value)`` in the order of seq, which is unique and not negative.

    Runs of operations are functions and compose, so a key's operations are folded in chunks of at most
    ``CHUNK`` sequence numbers first and the chunks' functions after; no task gathers all operations of a hot key.
    """
    f = ops.select(key, F.col(seq).alias("_seq"), _as_function(F.col(op), F.col(value)).alias("_f"))
    chunk = F.floor(F.col("_seq") / CHUNK).alias("_chunk")
    ordered_of = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, "_f"))), lambda x: x["_f"])
    partial = f.groupBy(key, chunk).agg(_composed(ordered_of("_seq")).alias("_f"))
    whole = partial.groupBy(key).agg(_composed(ordered_of("_chunk")).alias("_f"))
    both = base.select(key, F.col(value).alias("_old"), F.lit(True).alias("_there")).join(whole, key, "full")
    there = F.coalesce("_there", F.lit(False))
    g = F.col("_f")
    left = F.when(g.isNull(), there).when(there, g["p"]).otherwise(g["a"])
    new = F.when(g.isNull() | (there & g["k"]), F.col("_old")).when(there, g["pv"]).otherwise(g["av"])
    return both.where(left).select(key, new.alias(value))


def outcomes(base: DataFrame, ops: DataFrame, key: str, seq: str = "seq", op: str = "op") -> DataFrame:
    """``ops`` with ``done``: whether each operation of an ordered batch takes effect.

    Whether a key is there before an operation follows from running maxima: the last upsert or erase before it
    decides, unless an insert came later still. Maxima run within chunks of ``CHUNK`` sequence numbers and, a row for
    each, over a key's chunks, so no task sorts all operations of a hot key.
    """
    kinds = {"_fixed": ("upsert", "erase"), "_up": ("upsert",), "_in": ("insert_unique",)}
    at = {c: F.when(F.col(op).isin(*of), F.col(seq)) for c, of in kinds.items()}
    ops = ops.withColumn("_chunk", F.floor(F.col(seq) / CHUNK))
    run = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    chunks = ops.groupBy(key, "_chunk").agg(*(F.max(x).alias(c) for c, x in at.items()))
    before = chunks.select(key, "_chunk", *(F.max(c).over(run(key, "_chunk")).alias(f"_b{c}") for c in kinds))
    joined = ops.join(before, [key, "_chunk"], "left").join(base.select(key, F.lit(True).alias("_there")), key, "left")
    joined = joined.withColumns({c: F.greatest(F.col(f"_b{c}"), F.max(x).over(run(key, "_chunk", seq))) for c, x in at.items()})
    there = F.when(F.col("_fixed").isNull(), F.coalesce("_there", F.lit(False)) | F.col("_in").isNotNull()).otherwise((F.col("_fixed") == F.coalesce("_up", F.lit(-1))) | (F.coalesce("_in", F.lit(-1)) > F.col("_fixed")))
    done = F.when(F.col(op) == "upsert", True).when(F.col(op) == "insert_unique", ~there).otherwise(there)
    return joined.withColumn("done", done).drop("_there", "_chunk", *kinds, *(f"_b{c}" for c in kinds))


def layered_fold(layers: DataFrame, key: str, layer: str, seq: str, outcome: str) -> DataFrame:
    """Nested transactions: of the operations in layers that were not aborted, the last one of each key; a child's come after its parent's."""
    return last_writers(layers.where(F.col(outcome) != "abort").withColumn("_order", F.struct(layer, seq)), key, "_order").drop("_order")


def index_of(base: DataFrame, entry: Column, key: str) -> DataFrame:
    """Secondary index derived from the merged base: ``(entry, key)``; published together with it."""
    return base.select(entry.alias("entry"), key)
