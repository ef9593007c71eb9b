"""The message queue as functions from its state to what comes out and the new state.

State is one table: seq, state (ready, leased, dead), enqueued_ns, expires_ns (0: never), deliveries,
correlation_id, body, blob_key, lease_deadline_ns, token, dead_reason, dead_ns. Time is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError

SCHEMA = (
    "seq long, state string, enqueued_ns long, expires_ns long, deliveries int, correlation_id string, body binary, "
    "blob_key string, lease_deadline_ns long, token long, dead_reason string, dead_ns long"
)
READY, LEASED, DEAD = "ready", "leased", "dead"
EXPIRED, TOO_MANY, REJECTED = "expired", "too many deliveries", "rejected"
#: Most leases that one sweep returns.
SWEEP = 256


def check_options(name: str, lease_ns: int, ttl_ns: int, max_deliveries: int, linger_ns: int = 0) -> None:
    if not 1 <= len(name.encode()) <= 48 or "/" in name:
        raise StoreError(Code.INVALID_ARGUMENT, "a queue's name has 1 to 48 bytes and no /")
    if lease_ns <= 0 or ttl_ns < 0 or max_deliveries < 1 or linger_ns < 0:
        raise StoreError(Code.INVALID_ARGUMENT, "lease > 0, ttl >= 0, deliveries >= 1, linger >= 0")


def _settable(state: DataFrame, changes: dict[str, Column], when: Column) -> DataFrame:
    """State with columns set where ``when`` is true; types stay."""
    kinds = dict(state.dtypes)
    return state.select(*(F.when(when, changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in state.columns))


def is_expired(now_ns: int) -> Column:
    return (F.col("expires_ns") > 0) & (F.col("expires_ns") <= now_ns)


def send(messages: DataFrame, next_seq: int, now_ns: int, ttl_ns: int, order: list[str]) -> DataFrame:
    """New rows for ``messages(body, correlation_id, blob_key)``, numbered in order from ``next_seq``."""
    from tidemark.operators.shapes import numbered

    rows = numbered(messages, order, next_seq)
    none = F.lit(None)
    return rows.select(
        "seq", F.lit(READY).alias("state"), F.lit(now_ns).cast("long").alias("enqueued_ns"), F.lit(now_ns + ttl_ns if ttl_ns else 0).cast("long").alias("expires_ns"),
        F.lit(0).alias("deliveries"), "correlation_id", "body", "blob_key", F.lit(0).cast("long").alias("lease_deadline_ns"), F.lit(0).cast("long").alias("token"),
        none.cast("string").alias("dead_reason"), F.lit(0).cast("long").alias("dead_ns"),
    )


def peek(state: DataFrame) -> DataFrame:
    """Head of the queue, without a lease."""
    return state.where(F.col("state") == READY).orderBy("seq").limit(1)


def receive(state: DataFrame, now_ns: int, most: int, max_deliveries: int, lease_ns: int = 0, next_token: int = 1) -> DataFrame:
    """Ready rows that one receive touches, with ``outcome`` (leased or dead) and their new columns.

    In order of seq up to ``most`` deliverable ones are leased; undeliverable ones before the last of these die:
    expired, or delivered too often (that test comes second). The ready rows read are bounded by the receive: the
    ``most`` deliverable ones with the smallest seq are found first (top-n in each task).
    """
    ready = state.where(F.col("state") == READY)
    expired, spent = is_expired(now_ns), F.col("deliveries") + 1 > max_deliveries
    leased = ready.where(~expired & ~spent).orderBy("seq").limit(most)
    numbered = leased.withColumn("_k", F.row_number().over(Window.orderBy("seq")))  # ``most`` rows
    last = leased.agg(F.max("seq").alias("_last"), F.count(F.lit(1)).alias("_n"))
    dead = ready.where(expired | spent).join(F.broadcast(last))  # one row
    dead = dead.where((F.col("_n") < most) | (F.col("seq") < F.col("_last"))).drop("_last", "_n")
    one = _settable(numbered, {"state": F.lit(LEASED), "deliveries": F.col("deliveries") + 1, "lease_deadline_ns": F.lit(now_ns + lease_ns), "token": F.col("_k") - 1 + next_token}, F.lit(True)).drop("_k")
    reason = F.when(expired, EXPIRED).otherwise(TOO_MANY)
    two = _settable(dead, {"state": F.lit(DEAD), "dead_reason": reason, "dead_ns": F.lit(now_ns)}, F.lit(True))
    return one.unionByName(two)


def apply(state: DataFrame, changed: DataFrame) -> DataFrame:
    """State with the changed rows in place of those of the same seq."""
    from tidemark.operators.mutate import upsert

    return upsert(state, changed.select(*state.columns), "seq")


def ack(state: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State without leases that ``receipts(seq, token)`` settle, and the receipts that did; stale ones do nothing."""
    held = state.where(F.col("state") == LEASED).select("seq", "token")
    settled = receipts.select("seq", "token").join(held, ["seq", "token"], "left_semi")
    return state.join(settled.select("seq"), "seq", "left_anti"), settled


def ack_all_or_none(state: DataFrame, receipts: DataFrame) -> DataFrame:
    """State after all receipts; BadTransaction if any is stale."""
    after, settled = ack(state, receipts)
    if settled.count() != receipts.select("seq", "token").distinct().count():
        raise StoreError(Code.BAD_TRANSACTION, "a receipt is stale")
    return after


def nack(state: DataFrame, receipts: DataFrame, dead: bool, now_ns: int) -> DataFrame:
    """Leased messages back to ready under their seq with their count, or dead as rejected."""
    settled = receipts.select("seq", "token", F.lit(True).alias("_hit"))
    joined = state.join(settled, ["seq", "token"], "left").select(*state.columns, "_hit")
    hit = F.col("_hit") & (F.col("state") == LEASED)
    changes = {"state": F.lit(DEAD if dead else READY), "lease_deadline_ns": F.lit(0), "token": F.lit(0)}
    if dead:
        changes |= {"dead_reason": F.lit(REJECTED), "dead_ns": F.lit(now_ns)}
    return _settable(joined, changes, F.coalesce(hit, F.lit(False))).drop("_hit")


def due(state: DataFrame, now_ns: int, most: int = SWEEP) -> DataFrame:
    """Leases that have run out, lowest seq first, as many as one sweep takes."""
    return state.where((F.col("state") == LEASED) & (F.col("lease_deadline_ns") <= now_ns)).orderBy("seq").limit(most)


def sweep(state: DataFrame, now_ns: int, most: int = SWEEP) -> DataFrame:
    """State with due leases back to ready; each is checked again by seq, token and deadline."""
    from tidemark.operators.relate import still_valid

    again = still_valid(due(state, now_ns, most).select("seq", "token", "lease_deadline_ns"), state)
    return nack(state, again, False, now_ns)


def dead_letters(state: DataFrame, most: int | None = None) -> DataFrame:
    rows = state.where(F.col("state") == DEAD).orderBy("seq")
    return rows if most is None else rows.limit(most)


def purge(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State without dead letters, and how many there were."""
    return state.where(F.col("state") != DEAD), state.where(F.col("state") == DEAD).agg(F.count(F.lit(1)).alias("purged"))


def counts(state: DataFrame) -> DataFrame:
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def next_token(state: DataFrame) -> DataFrame:
    return state.agg((F.coalesce(F.max("token"), F.lit(0)) + 1).cast("long").alias("next_token"))
