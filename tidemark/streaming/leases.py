"""Leases and expiry as a stateful stream, and batched queue writes from a stream.

:func:`lease_stream` keeps the state of each message in a state store: deliveries, settlements and deadlines come as
events, and processing-time timers fire for leases that run out. :func:`writer` sends the rows of each micro-batch in
one transaction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "seq long, kind string, token long, deadline_ms long"
OUTPUT = "seq long, token long, outcome string, deliveries int"


class Leases(StatefulProcessor):
    """Events ``lease`` (token, deadline), ``ack`` and ``nack`` (token) of one message to outcomes settled, returned, stale, due or dead."""

    def __init__(self, max_deliveries: int):
        self.max_deliveries = max_deliveries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "token long, deadline_ms long, deliveries int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for pdf in rows:
            for kind, token, deadline in zip(pdf["kind"], pdf["token"], pdf["deadline_ms"]):
                held = self.lease.get() if self.lease.exists() else None
                if kind == "lease":
                    count = (held[2] if held else 0) + 1
                    if count > self.max_deliveries:
                        self.lease.clear()
                        out.append((key[0], int(token), "dead", count - 1))
                        continue
                    self.lease.update((int(token), int(deadline), count))
                    self.handle.registerTimer(int(deadline))
                elif held is None or held[0] != int(token):
                    out.append((key[0], int(token), "stale", held[2] if held else 0))
                elif kind == "ack":
                    self.lease.clear()
                    out.append((key[0], int(token), "settled", held[2]))
                else:
                    self.lease.update((0, 0, held[2]))
                    out.append((key[0], int(token), "returned", held[2]))
        yield pd.DataFrame(out, columns=["seq", "token", "outcome", "deliveries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.lease.exists():
            token, deadline, count = self.lease.get()
            if token and deadline <= expiredTimerInfo.getExpiryTimeInMs():
                self.lease.update((0, 0, count))
                out.append((key[0], token, "due", count))
        yield pd.DataFrame(out, columns=["seq", "token", "outcome", "deliveries"])

    def close(self) -> None:
        return None


def lease_stream(events: DataFrame, max_deliveries: int = 5) -> DataFrame:
    """``events`` (see ``EVENTS``) to outcomes (``OUTPUT``), keyed by message; needs the RocksDB state store."""
    return events.groupBy("seq").transformWithStateInPandas(Leases(max_deliveries), outputStructType=OUTPUT, outputMode="append", timeMode="ProcessingTime")


def writer(queue, order: list[str], max_bytes: int | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: send a micro-batch's ``(body, correlation_id, blob_key)`` rows in one transaction.

    The number of the batch goes into the same transaction, so a batch that is run again sends nothing.
    """
    from pyspark.sql import functions as F

    from tidemark.errors import Code, StoreError

    def send(batch: DataFrame, number: int) -> None:
        if max_bytes is not None:
            size = batch.agg(F.sum(F.octet_length("body"))).first()[0] or 0
            if size > max_bytes:
                raise StoreError(Code.BUSY, f"{size} bytes in one batch")
        with queue.store.write() as t:
            done = t.get(b"stream", queue.meta)
            if done is None or int(done) < number:
                queue.send(batch, order, t)
                t.put(b"stream", str(number).encode(), queue.meta)

    return send
