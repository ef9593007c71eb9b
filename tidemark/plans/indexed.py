"""A tree with a secondary index: both change in one commit.

``entry_of`` makes an index key from an entry's key and value columns. Writing a batch retracts the index entries of
the rows it replaces or erases, writes the rows, and enters the new ones, all staged in the caller's transaction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relate import by_index
from tidemark.plans.store import View, WriteTxn


class Indexed:
    def __init__(self, db: str, index: str, entry_of: Callable[[Column, Column], Column]):
        self.db, self.index, self.entry_of = db, index, entry_of

    def create(self, t: WriteTxn) -> None:
        t.db(self.db), t.db(self.index)

    def _entries(self, rows: DataFrame, op: str, first: int) -> DataFrame:
        entry = self.entry_of(F.col("key"), F.col("value"))
        value = F.col("key") if op == "upsert" else F.lit(None).cast("binary")
        return rows.select((F.monotonically_increasing_id() + first).alias("seq"), F.lit(op).alias("op"), entry.alias("key"), value.alias("value"))

    def upsert(self, t: WriteTxn, batch: DataFrame) -> None:
        """``batch(key, value)``, each key once."""
        self._replace(t, batch.select("key"), batch)

    def erase(self, t: WriteTxn, keys: DataFrame) -> None:
        self._replace(t, keys.select("key"), None)

    def _replace(self, t: WriteTxn, keys: DataFrame, batch: DataFrame | None) -> None:
        from tidemark.session import materialize

        old, _ = materialize(t.entries(self.db).join(keys.distinct(), "key", "left_semi").select("key", "value"), "replaced")
        number = F.monotonically_increasing_id().alias("seq")
        t.stage(self._entries(old, "erase", 0), self.index)
        if batch is None:
            t.stage(keys.select(number, F.lit("erase").alias("op"), "key", F.lit(None).cast("binary").alias("value")), self.db)
        else:
            t.stage(batch.select(number, F.lit("upsert").alias("op"), "key", "value"), self.db)
            t.stage(self._entries(batch, "upsert", 0), self.index)

    def lookup(self, view: View, prefix: bytes) -> DataFrame:
        """Rows whose index entries start with ``prefix``, in index order: ``(key, entry, value)``."""
        found = view.prefix(prefix, self.index).select(F.col("okey").alias("entry"), F.col("value").alias("key"))
        return by_index(found, view.entries(self.db).select("key", "value"), "key", "entry")
