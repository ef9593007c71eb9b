"""A durable work queue in the store: one tree of messages, changed inside write transactions.

A message's key is its number (8 bytes, big-endian), its value the other columns as JSON with the body in base64;
a record beside them holds counters and the queue's identity. Every operation is a transform of :mod:`tidemark.operators.queue` on the
tree's DataFrame, staged as upserts and erases of the rows it changes, so it can share a transaction with the
work it acknowledges. Time is an argument everywhere; without one the clock is read.

A receipt is good for the queue that gave it, in the store that gave it. Lease tokens are never given twice by a
process, not even if the transaction that gave one is dropped.
"""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from concurrent.futures import Future
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError
from tidemark.functions.order import big_endian
from tidemark.operators import queue as q
from tidemark.plans.store import Store, View, WriteTxn
from tidemark.session import materialize

COUNTERS = b"counters"


#: The largest token that this process has given, by store folder and queue identity.
_GIVEN: dict[tuple[str, str], int] = {}
_GIVING = threading.Lock()


@dataclass
class Receipt:
    seq: int
    token: int
    queue_id: str = ""
    store: str = ""


@dataclass
class Message:
    seq: int
    body: bytes
    correlation_id: str | None
    deliveries: int
    receipt: Receipt | None = None


class MessageQueue:
    def __init__(self, store: Store, name: str, lease_ns: int = 30_000_000_000, ttl_ns: int = 0, max_deliveries: int = 5, linger_ns: int = 0, blobs=None, blob_threshold: int | None = None):
        q.check_options(name, lease_ns, ttl_ns, max_deliveries, linger_ns)
        self.store, self.db, self.meta = store, f"mq/{name}", f"mq/{name}/meta"
        self.lease_ns, self.ttl_ns, self.max_deliveries = lease_ns, ttl_ns, max_deliveries
        self.blobs, self.blob_threshold = blobs, blob_threshold
        with store.read() as s:
            there = s.has_db(self.db)
        if not there:
            with store.write() as t:
                if not t.has_db(self.db):  # else another opener was first
                    t.db(self.db), t.db(self.meta)
                    t.put(COUNTERS, json.dumps({"next_seq": 1, "next_token": 1, "id": uuid.uuid4().hex}).encode(), self.meta)
        with store.read() as s:
            self.id = self._counters(s)["id"]
        self._place = os.path.realpath(store.path), self.id

    @staticmethod
    def _now(now_ns: int | None) -> int:
        return time.time_ns() if now_ns is None else now_ns

    def state(self, view: View) -> DataFrame:
        """The queue's table as a view sees it."""
        wire = q.SCHEMA.replace("body binary", "body string")
        rows = view.entries(self.db).select(F.from_json(F.decode("value", "UTF-8"), wire).alias("m")).select("m.*")
        return rows.withColumn("body", F.unbase64("body"))

    def _stage(self, t: WriteTxn, changed: DataFrame, op: str = "upsert") -> None:
        wire = changed.withColumn("body", F.base64("body"))
        rows = wire.select(F.col("seq"), F.lit(op).alias("op"), big_endian(F.col("seq")).alias("key"), (F.encode(F.to_json(F.struct(*wire.columns)), "UTF-8") if op != "erase" else F.lit(None).cast("binary")).alias("value"))
        t.stage(rows, self.db)

    def _counters(self, view: View) -> dict:
        return json.loads(view.at(COUNTERS, self.meta))

    def _set(self, t: WriteTxn, **counters) -> None:
        t.put(COUNTERS, json.dumps(self._counters(t) | counters).encode(), self.meta)

    def _in(self, txn: WriteTxn | None):
        return self.store.write() if txn is None else _given(txn)

    # --- sending ----------------------------------------------------------------------------------------------------
    def send_many(self, bodies: list[bytes], correlation_id: str | None = None, txn: WriteTxn | None = None, now_ns: int | None = None) -> list[int]:
        rows = [(i, b, correlation_id, None) for i, b in enumerate(bodies)]
        if self.blobs is not None and self.blob_threshold is not None:
            large, at = [], time.time_ns()
            for i, (n, b, c, _) in enumerate(rows):
                if len(b) >= self.blob_threshold:
                    key = f"{self.db}/{at}/{n}"
                    large.append((key.encode(), f"{xxhash.xxh3_64_hexdigest(key.encode())}-{n}.bin", b))
                    rows[i] = (n, None, c, key)
            if large:
                self.blobs.put_many(large)  # stored, in one commit, before the messages that name them
        batch = self.store.spark.createDataFrame(rows, "n long, body binary, correlation_id string, blob_key string")
        return self.send(batch, ["n"], txn, now_ns)

    def send(self, batch: DataFrame, order: list[str], txn: WriteTxn | None = None, now_ns: int | None = None) -> list[int]:
        """Send ``batch(body, correlation_id, blob_key)`` in the given order; returns first and last number as a list of all."""
        with self._in(txn) as t:
            first, n = self._counters(t)["next_seq"], batch.count()
            if n:
                self._stage(t, q.send(batch, first, self._now(now_ns), self.ttl_ns, order))
                self._set(t, next_seq=first + n)
            return list(range(first, first + n))

    # --- receiving ----------------------------------------------------------------------------------------------------
    def peek(self) -> Message | None:
        with self.store.read() as s:
            row = q.peek(self.state(s)).first()
            return None if row is None else self._message(row)

    def _message(self, r, receipt: bool = False) -> Message:
        body = bytes(r.body) if r.body is not None else self.blobs.get(r.blob_key.encode()) if r.blob_key else b""
        return Message(r.seq, body, r.correlation_id, r.deliveries, Receipt(r.seq, r.token, self.id, self._place[0]) if receipt else None)

    def receive(self, most: int = 1, txn: WriteTxn | None = None, now_ns: int | None = None) -> list[Message]:
        """Lease up to ``most`` messages; undeliverable ones on the way become dead letters. No commit if nothing changes."""
        now = self._now(now_ns)
        if txn is None:
            with self.store.read() as s:  # a look before taking the writer's place
                if self.state(s).where(F.col("state") == q.READY).isEmpty():
                    return []
        with self._in(txn) as t:
            token = max(self._counters(t)["next_token"], _GIVEN.get(self._place, 0) + 1)
            touched = q.receive(self.state(t), now, most, self.max_deliveries, self.lease_ns, token)
            rows = touched.where(F.col("state") == q.LEASED).orderBy("seq").collect()  # at most ``most``
            self._stage(t, touched)
            if rows:
                with _GIVING:  # stands even if the transaction is dropped: the caller may hold the receipts
                    _GIVEN[self._place] = max(_GIVEN.get(self._place, 0), token + len(rows) - 1)
                self._set(t, next_token=token + len(rows))
            return [self._message(r, True) for r in rows]

    def wait(self, timeout: float, most: int = 1) -> list[Message]:
        """Receive, waiting for commits until the timeout; the version is sampled before each try, so no wake-up is lost."""
        end = time.monotonic() + timeout
        while True:
            seen = self.store.version
            got = self.receive(most)
            left = end - time.monotonic()
            if got or left <= 0:
                return got
            self.store.wait_for_commit(seen, left)

    # --- settling -----------------------------------------------------------------------------------------------------
    def _receipts(self, receipts: list[Receipt]) -> DataFrame:
        if any((r.store, r.queue_id) != self._place for r in receipts):
            raise StoreError(Code.BAD_TRANSACTION, "a receipt is of another queue or store")
        return self.store.spark.createDataFrame([(r.seq, r.token) for r in receipts], "seq long, token long")

    def ack(self, receipts: list[Receipt], txn: WriteTxn | None = None) -> int:
        """Settle leases; returns how many. A stale receipt does nothing, but breaks a caller's transaction."""
        if not receipts:
            return 0
        try:
            rows = self._receipts(receipts)
        except StoreError:
            if txn is not None:
                txn.abort()
            raise
        if txn is not None:
            settled = q.ack(self.state(txn), rows)[1]
            n = settled.count()
            if n != len({(r.seq, r.token) for r in receipts}):
                txn.abort()
                raise StoreError(Code.BAD_TRANSACTION, "a receipt is stale")
            self._erase(txn, settled)
            return n
        with self.store.write() as t:
            settled = q.ack(self.state(t), rows)[1]
            self._erase(t, settled)
            return settled.count()

    def _erase(self, t: WriteTxn, seqs: DataFrame) -> None:
        t.stage(seqs.select("seq", F.lit("erase").alias("op"), big_endian(F.col("seq")).alias("key"), F.lit(None).cast("binary").alias("value")), self.db)

    def nack(self, receipts: list[Receipt], dead: bool = False, txn: WriteTxn | None = None, now_ns: int | None = None) -> None:
        """Back to ready under the old number and count, or to the dead letters as rejected."""
        with self._in(txn) as t:
            state, rows = self.state(t), self._receipts(receipts)
            changed = q.nack(state.join(q.ack(state, rows)[1].select("seq"), "seq", "left_semi"), rows, dead, self._now(now_ns))
            self._stage(t, changed)

    def sweep(self, now_ns: int | None = None) -> int:
        """Return leases that have run out, at most 256; returns how many."""
        now = self._now(now_ns)
        with self.store.read() as s:
            if q.due(self.state(s), now, 1).isEmpty():
                return 0
        with self.store.write() as t:
            state = self.state(t)
            due = q.due(state, now)
            n = due.count()
            self._stage(t, q.nack(due, due.select("seq", "token"), False, now))
            return n

    # --- looking ------------------------------------------------------------------------------------------------------
    def counts(self) -> dict[str, int]:
        with self.store.read() as s:
            return {q.READY: 0, q.LEASED: 0, q.DEAD: 0} | {r.state: r.n for r in q.counts(self.state(s)).collect()}

    def dead_letters(self, most: int | None = None) -> DataFrame:
        """Dead letters as of now, written aside, so that they outlive the version they were read from."""
        with self.store.read() as s:
            return materialize(q.dead_letters(self.state(s), most), "dead-letters")[0].orderBy("seq")

    def purge(self) -> int:
        with self.store.write() as t:
            dead = self.state(t).where(F.col("state") == q.DEAD)
            n = dead.count()
            self._erase(t, dead)
            return n


class QueueWriter:
    """Messages of many threads, sent by one thread in shared commits.

    A commit takes what has come by ``linger`` seconds after its first message, ``most`` messages at most. Beyond
    ``max_bytes`` of waiting bodies a submission is refused as Busy. A commit that fails fails for all its messages.
    """

    def __init__(self, queue: MessageQueue, most: int = 256, linger: float = 0.01, max_bytes: int = 8 << 20):
        if most < 1 or linger < 0 or max_bytes < 1:
            raise StoreError(Code.INVALID_ARGUMENT, "most >= 1, linger >= 0, max_bytes >= 1")
        self.queue, self.most, self.linger, self.max_bytes = queue, most, linger, max_bytes
        self._change = threading.Condition()
        self._waiting: list[tuple[bytes, Future]] = []
        self._bytes, self._closed = 0, False
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def submit(self, body: bytes) -> Future:
        """The message's number, once it is committed."""
        with self._change:
            if self._closed:
                raise StoreError(Code.BAD_TRANSACTION, "the writer is closed")
            if self._bytes + len(body) > self.max_bytes:
                raise StoreError(Code.BUSY, f"{self._bytes} bytes are waiting")
            done: Future = Future()
            self._waiting.append((body, done))
            self._bytes += len(body)
            self._change.notify_all()
            return done

    def _run(self) -> None:
        while True:
            with self._change:
                while not self._waiting and not self._closed:
                    self._change.wait()
                if not self._waiting:
                    return
                end = time.monotonic() + self.linger
                while len(self._waiting) < self.most and not self._closed and (left := end - time.monotonic()) > 0:
                    self._change.wait(left)
                batch, self._waiting = self._waiting[: self.most], self._waiting[self.most :]
                self._bytes -= sum(len(b) for b, _ in batch)
            try:
                numbers = self.queue.send_many([b for b, _ in batch])
            except BaseException as e:
                for _, done in batch:
                    done.set_exception(e)
                continue
            for n, (_, done) in zip(numbers, batch):
                done.set_result(n)

    def close(self) -> None:
        """Send what is waiting, then end."""
        with self._change:
            self._closed = True
            self._change.notify_all()
        self._thread.join()


class _given:
    """A transaction that its owner ends."""

    def __init__(self, txn: WriteTxn):
        self.txn = txn

    def __enter__(self) -> WriteTxn:
        return self.txn

    def __exit__(self, *exc) -> None:
        return None
