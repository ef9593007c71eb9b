"""The store: named ordered trees under versioned manifests.

Reads are DataFrames over the files of one version. A write transaction stages batches of operations; its commit
folds them (:func:`tidemark.operators.mutate.fold`), rewrites only the files whose key ranges the batch touches,
and publishes the next manifest. Each commit is a Spark job, so the interface takes batches; small batches may be
Python lists. Paths are local or mounted folders that driver and executors share.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from tidemark.errors import Code, StoreError
from tidemark.functions import order as ord_
from tidemark.operators import mutate, relate
from tidemark.plans import manifest as mf
from tidemark.plans.manifest import File, Manifest, Tree
from tidemark.session import drop_folder, materialize

ENTRY = "okey binary, key binary, value binary"
OPS = "seq long, op string, okey binary, key binary, value binary"
SAFE, NO_META_SYNC, LAZY, NONE = "safe", "no_meta_sync", "lazy", "none"
#: Keys that a commit wrote are recorded up to this many; a larger one conflicts with all readers.
LOGGED_KEYS = 1 << 20
#: Keys of a batch up to this many stand in the manifest, those of a larger one in files beside it.
INLINE_KEYS = 1024


@dataclass
class Options:
    read_only: bool = False
    create_if_missing: bool = True
    error_if_exists: bool = False
    max_dbs: int = 128
    max_size: int | None = None
    sync: str = SAFE
    sync_interval: float = 1.0
    background_sync: bool = False
    rows_per_file: int = 1_000_000
    retain: int = 16
    busy_timeout: float | None = None
    verify_reads: bool = False
    pin_ttl: float = 3600.0
    on_reader_lag: Callable[[int, int], None] | None = None


class Store:
    """Open with :meth:`Store.open`; a context manager."""

    def __init__(self, spark: SparkSession, path: str, options: Options, manifest: Manifest, rolled_back: int | None):
        self.spark, self.path, self.options, self.rolled_back = spark, path, options, rolled_back
        self._unsynced: Manifest | None = None
        self._manifest = manifest
        self._synced_at = time.monotonic()
        self._verified: set[str] = set()
        self._lock = threading.Lock()
        self._syncing = threading.RLock()
        self._timer: threading.Timer | None = None
        self.closed = False

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> Store:
        opts = Options(**options)
        path = path.removeprefix("file://").rstrip("/")
        if "://" in path:
            raise StoreError(Code.UNSUPPORTED, "manifests need a mounted folder with exclusive create")
        there = bool(mf.versions(path))
        if there and opts.error_if_exists:
            raise StoreError(Code.KEY_EXISTS, path)
        if not there:
            if opts.read_only or not opts.create_if_missing:
                raise StoreError(Code.NOT_FOUND, path)
            os.makedirs(f"{path}/data", exist_ok=True)
            try:
                mf.publish(path, mf.fresh())
            except StoreError as e:
                if e.code is not Code.CONFLICT:  # else another process made it
                    raise
        return cls(spark, path, opts, *mf.recover(path))

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    def close(self) -> None:
        if not self.closed:
            self.sync()
            self.closed = True

    # --- identity -----------------------------------------------------------------------------------------------
    @property
    def manifest(self) -> Manifest:
        """The newest version, also of other processes unless commits wait here for a sync."""
        if self._unsynced is None:
            newest = mf.versions(self.path)[-1]
            if newest != self._manifest.version:
                self._manifest, self.rolled_back = mf.recover(self.path)
        return self._manifest

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def store_id(self) -> str:
        return self.manifest.store_id

    max_key_size = ord_.MAX_KEY

    def checkpoint(self) -> dict:
        return self.manifest.checkpoint

    def wait_for_commit(self, seen: int, timeout: float) -> int:
        """The version once it is past ``seen``, or after the timeout; takes no lock."""
        end = time.monotonic() + timeout
        while (now := self.version) <= seen and time.monotonic() < end:
            time.sleep(0.02)
        return now

    # --- reading ----------------------------------------------------------------------------------------------------
    def snapshot(self, version: int | None = None) -> Snapshot:
        """A frozen view; pins its version against vacuum while it is open."""
        m = self.manifest if version is None or version == self._manifest.version else mf.load(self.path, version)
        return Snapshot(self, m)

    @contextmanager
    def read(self):
        s = self.snapshot()
        try:
            yield s
        finally:
            s.close()

    def scan(self, manifest: Manifest, name: str | None, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        """Entries of a tree with lo <= okey < hi, from the files whose bounds allow it."""
        files = [f for f in manifest.tree(name).files if (lo is None or f.bounds[1] >= lo) and (hi is None or f.bounds[0] < hi)]
        if not files:
            return self.spark.createDataFrame([], ENTRY)
        if self.options.verify_reads:
            self._verify(files)
        df = self.spark.read.schema(ENTRY).parquet(*(f"{self.path}/{f.path}" for f in files))
        if lo is not None:
            df = df.where(F.col("okey") >= F.lit(lo))
        return df if hi is None else df.where(F.col("okey") < F.lit(hi))

    def _verify(self, files: list[File]) -> None:
        """Digests of files not verified before by this handle."""
        from tidemark.plans.inspect import file_digests

        new = [f for f in files if f.path not in self._verified]
        if not new:
            return
        bad = {f.path: f.digest for f in new}
        for row in file_digests(self.spark, self.path, list(bad)).toLocalIterator():
            if bad.get(row.path) == row.digest:
                del bad[row.path]
        if bad:
            raise StoreError(Code.CORRUPTED, ", ".join(sorted(bad)))
        self._verified |= {f.path for f in new}

    def invalidate_read_cache(self) -> None:
        self._verified.clear()

    # --- writing ----------------------------------------------------------------------------------------------------
    @contextmanager
    def writer(self, timeout: float | None = None):
        """The one writer's place, in this process and across processes; Busy after the timeout."""
        if self.options.read_only:
            raise StoreError(Code.READ_ONLY)
        timeout = self.options.busy_timeout if timeout is None else timeout
        if not self._lock.acquire(timeout=-1 if timeout is None else timeout):
            raise StoreError(Code.BUSY, "another writer of this process")
        try:
            with open(f"{self.path}/writer.lock", "a") as f:
                end = None if timeout is None else time.monotonic() + timeout
                while True:
                    try:
                        fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                        break
                    except OSError:
                        if end is not None and time.monotonic() >= end:
                            raise StoreError(Code.BUSY, "another process writes") from None
                        time.sleep(0.01)
                yield
        finally:
            self._lock.release()

    @contextmanager
    def write(self, timeout: float | None = None):
        """A write transaction: committed on return, dropped on an exception."""
        with self.writer(timeout):
            txn = WriteTxn(self, self.manifest)
            try:
                yield txn
            except BaseException:
                txn.abort()
                raise
            if not txn.done:
                txn.commit()

    def publish(self, m: Manifest) -> None:
        if self.options.max_size is not None and sum(t.bytes for t in m.all_trees().values()) > self.options.max_size:
            raise StoreError(Code.MAP_FULL)
        if self.options.sync in (LAZY, NONE):
            with self._syncing:
                if self._unsynced is not None:  # versions that are never written: the next one answers for them
                    m.wrote = None if m.wrote is None or self._unsynced.wrote is None else self._unsynced.wrote + m.wrote
                    m.logs = self._unsynced.logs + m.logs
                self._unsynced = self._manifest = m.sealed()
                if self.options.sync == LAZY and time.monotonic() - self._synced_at >= self.options.sync_interval:
                    self.sync()
                elif self.options.sync == LAZY and self.options.background_sync and self._timer is None:
                    self._timer = threading.Timer(self.options.sync_interval, self.sync)
                    self._timer.daemon = True
                    self._timer.start()
            return
        mf.publish(self.path, m)
        self._manifest = m
        if self.options.on_reader_lag and (pinned := self.pins()) and min(pinned) < m.version:
            self.options.on_reader_lag(min(pinned), m.version)

    def sync(self) -> None:
        """Make commits that wait (LAZY, NONE) durable; several become one version of the chain.

        With ``background_sync`` a LAZY commit is made durable after the interval even if no other follows.
        """
        with self._syncing:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            if self._unsynced is not None:
                m, self._unsynced = self._unsynced, None
                mf.publish(self.path, m)
            self._synced_at = time.monotonic()

    # --- files ------------------------------------------------------------------------------------------------------
    def write_files(self, df: DataFrame, entries: int | None = None, stretches: list[bytes] | None = None) -> list[File]:
        """Entries as sorted files with disjoint ranges; returns their manifest rows.

        ``entries`` may be an upper bound. With ``stretches`` (first keys, in order) no file crosses from one
        stretch to the next.
        """
        n = df.count() if entries is None else entries
        if not n:
            return []
        folder = f"data/{uuid.uuid4().hex}"
        parts = max(1, -(-n // self.options.rows_per_file))
        if stretches and len(stretches) > 1:
            dealt = df.withColumn("_s", stretch_of(stretches)("okey")).repartitionById(len(stretches), F.col("_s"))
        else:
            dealt = df.repartitionByRange(parts, "okey") if parts > 1 else df.coalesce(1)
        rows = dealt.sortWithinPartitions("okey").select("okey", "key", "value")
        rows.write.option("maxRecordsPerFile", self.options.rows_per_file).parquet(f"{self.path}/{folder}")
        return self._measured(folder)

    def _measured(self, folder: str) -> list[File]:
        """Bounds, sizes and digests of the sorted files in a folder: one row for each file."""
        from tidemark.plans.inspect import measure

        names = [n for n in os.listdir(f"{self.path}/{folder}") if n.endswith(".parquet")]
        safe = self.options.sync in (SAFE, NO_META_SYNC)  # files are on disk before a manifest names them
        found = measure(self.spark, self.path, [f"{folder}/{n}" for n in names], safe).where("n > 0").collect()
        if safe:
            mf.sync_folder(f"{self.path}/{folder}")
            mf.sync_folder(f"{self.path}/data")
        return sorted((File(r.path, bytes(r.lo).hex(), bytes(r.hi).hex(), r.n, r.bytes, r.digest) for r in found), key=lambda f: f.bounds)

    # --- housekeeping -------------------------------------------------------------------------------------------------
    def pins(self) -> dict[int, int]:
        """Readers by pinned version; pins older than ``pin_ttl`` do not count."""
        out: dict[int, int] = {}
        folder = f"{self.path}/pins"
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            try:
                fresh = time.time() - os.path.getmtime(f"{folder}/{name}") < self.options.pin_ttl
            except FileNotFoundError:
                continue
            if fresh:
                v = int(name.split("-")[0])
                out[v] = out.get(v, 0) + 1
        return out

    def reclaimable(self, retain: int | None = None) -> tuple[list[int], set[str]]:
        """Versions beyond the retained and pinned ones, and files on disk that no kept version names."""
        all_versions = mf.versions(self.path)
        kept = set(all_versions[-(self.options.retain if retain is None else max(1, retain)) :]) | set(self.pins())
        live = set().union(*(mf.load(self.path, v).paths() for v in all_versions if v in kept), self._manifest.paths())
        on_disk = {os.path.relpath(os.path.join(d, n), self.path) for d, _, names in os.walk(f"{self.path}/data") for n in names if n.endswith(".parquet")}
        return [v for v in all_versions if v not in kept], on_disk - live

    def vacuum(self, retain: int | None = None) -> int:
        """Delete what is reclaimable; returns bytes freed. Staged files of a running writer are not touched: it holds the writer's place."""
        with self.writer():
            old, files = self.reclaimable(retain)
            freed = sum(os.path.getsize(f"{self.path}/{p}") for p in files)
            for v in old:
                mf.remove(self.path, v)
            for p in files:
                os.unlink(f"{self.path}/{p}")
                folder = os.path.dirname(f"{self.path}/{p}")
                if not any(n.endswith(".parquet") for n in os.listdir(folder)):
                    shutil.rmtree(folder)
            named = {folder for v in mf.versions(self.path) for _, folder, _ in mf.load(self.path, v).logs} | {folder for _, folder, _ in self._manifest.logs}
            for name in os.listdir(f"{self.path}/logs") if os.path.isdir(f"{self.path}/logs") else []:
                if f"logs/{name}" not in named:  # of a commit that did not get to publish
                    shutil.rmtree(f"{self.path}/logs/{name}")
            return freed

    def shrink(self, fill: float = 0.5) -> int:
        """Rewrite runs of files that are filled less than ``fill``, then vacuum; returns bytes freed."""
        with self.write() as txn:
            for name, tree in txn.manifest.all_trees().items():
                small = [f for f in tree.files if f.entries < fill * self.options.rows_per_file]
                if len(small) > 1:
                    txn.rewrite(name, small)
        return self.vacuum(retain=1)

    def compact(self, path: str, **options) -> Store:
        """Dense copy with identities of its own; the destination must be new."""
        if mf.versions(path):
            raise StoreError(Code.KEY_EXISTS, path)
        with self.read() as snap:
            new = Store.open(self.spark, path, **({"rows_per_file": self.options.rows_per_file} | options))
            m = new.manifest.child()
            for name, tree in snap.manifest.all_trees().items():
                files = new.write_files(self.scan(snap.manifest, name), tree.entries)
                copy = Tree(tree.order, tree.width, tree.prefix_keys, files)
                if name is None:
                    m.main = copy
                else:
                    m.trees[name] = copy
            new.publish(m)
        return new

    def copy_snapshot(self, snap: Snapshot, path: str) -> None:
        """Files and manifest of a read snapshot, same checkpoint; the destination must be new."""
        if os.path.exists(path):
            raise StoreError(Code.KEY_EXISTS, path)
        from tidemark.plans.inspect import copy_files

        os.makedirs(f"{path}/data", exist_ok=True)
        copy_files(self.spark, self.path, path, sorted(snap.manifest.paths()))
        os.makedirs(f"{path}/manifests", exist_ok=True)
        shutil.copyfile(mf._name(self.path, snap.manifest.version), mf._name(path, snap.manifest.version))


class View:
    """Reading trees of some state; subclasses say what the state's entries are."""

    store: Store
    manifest: Manifest

    def entries(self, name: str | None, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        raise NotImplementedError

    def _okey(self, name: str | None, key: bytes) -> bytes:
        tree = self.manifest.tree(name)
        if tree.order in ord_.WIDTH and len(key) != (tree.width or ord_.WIDTH[tree.order]):
            raise StoreError(Code.INVALID_ARGUMENT, "width of an integer key")
        return ord_.encode_bytes(key, tree.order)

    def dbs(self) -> list[str]:
        return sorted(self.manifest.trees, key=str.encode)

    def has_db(self, name: str) -> bool:
        return name in self.manifest.trees

    def all(self, db: str | None = None) -> DataFrame:
        return self.entries(db).orderBy("okey")

    def from_(self, lo: bytes, db: str | None = None) -> DataFrame:
        return self.entries(db, self._okey(db, lo)).orderBy("okey")

    def upto(self, hi: bytes, db: str | None = None) -> DataFrame:
        """Below ``hi``; an empty bound leaves nothing."""
        return self.between(None, hi, db)

    def between(self, lo: bytes | None, hi: bytes, db: str | None = None) -> DataFrame:
        low = None if lo is None else self._okey(db, lo)
        return self.entries(db, low, self._okey(db, hi) if hi else b"").orderBy("okey")

    def prefix(self, p: bytes, db: str | None = None) -> DataFrame:
        """Keys that start with ``p``; in reversed-byte order, that end with it."""
        encoded = ord_.encode_bytes(p, self.manifest.tree(db).order)
        found = self.entries(db, encoded, ord_.successor(encoded))
        return found.where(F.col("okey").startswith(F.lit(encoded))).orderBy("okey")

    def get(self, key: bytes, db: str | None = None) -> bytes | None:
        okey = self._okey(db, key)
        row = self.entries(db, okey, okey + b"\0").select("value").first()
        return None if row is None else bytes(row.value)

    def at(self, key: bytes, db: str | None = None) -> bytes:
        value = self.get(key, db)
        if value is None:
            raise StoreError(Code.NOT_FOUND, key.hex())
        return value

    def contains(self, key: bytes, db: str | None = None) -> bool:
        return self.get(key, db) is not None

    def find_many(self, keys: list[bytes], db: str | None = None) -> list[bytes | None]:
        """Values in the order of the keys, None for misses: one sorted batch, one job."""
        if not keys:
            return []
        probes = self.store.spark.createDataFrame([(self._okey(db, k),) for k in dict.fromkeys(keys)], "okey binary")
        okeys = [self._okey(db, k) for k in keys]
        found = {bytes(r.okey): bytes(r.value) for r in relate.probe(self.entries(db, min(okeys), max(okeys) + b"\0"), probes, "okey").where("value is not null").select("okey", "value").collect()}
        return [found.get(k) for k in okeys]

    def first(self, db: str | None = None, n: int = 1) -> DataFrame:
        return self.entries(db).orderBy("okey").limit(n)

    def last(self, db: str | None = None, n: int = 1) -> DataFrame:
        return self.entries(db).orderBy(F.desc("okey")).limit(n)

    def seek(self, key: bytes, db: str | None = None) -> DataFrame:
        return self.entries(db, self._okey(db, key)).orderBy("okey").limit(1)

    def count(self, db: str | None = None) -> int:
        return self.entries(db).count()

    def count_range(self, lo: bytes, hi: bytes, db: str | None = None) -> int:
        """Entries in [lo, hi); empty bounds count as none."""
        low, high = (self._okey(db, b) if b else None for b in (lo, hi))
        if low is not None and high is not None and high <= low:
            return 0
        return self._count(db, low, high)

    def rank(self, key: bytes, db: str | None = None) -> int:
        return self._count(db, None, self._okey(db, key))

    def _count(self, db: str | None, low: bytes | None, high: bytes | None) -> int:
        return self.entries(db, low, high).count()

    def skip(self, n: int, db: str | None = None) -> DataFrame:
        """The entry n places after the first, or none."""
        return self.entries(db).orderBy("okey").offset(n).limit(1)


class Snapshot(View):
    """A version of the store, frozen."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.manifest = store, manifest
        self._pin = f"{store.path}/pins/{manifest.version}-{uuid.uuid4().hex}"
        if not store.options.read_only:
            os.makedirs(f"{store.path}/pins", exist_ok=True)
            open(self._pin, "w").close()

    def close(self) -> None:
        try:
            os.unlink(self._pin)
        except FileNotFoundError:
            pass

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    @property
    def id(self) -> int:
        return self.manifest.version

    def belongs_to(self, store: Store) -> bool:
        return self.store is store

    def entries(self, name: str | None, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        return self.store.scan(self.manifest, name, lo, hi)

    def count(self, db: str | None = None) -> int:
        return self.manifest.tree(db).entries  # exact, from the manifest

    def _count(self, db: str | None, low: bytes | None, high: bytes | None) -> int:
        """Files inside the range from the manifest; at most two files at its ends are read."""
        total, ends = 0, []
        for f in self.manifest.tree(db).files:
            lo, hi = f.bounds
            if (low is not None and hi < low) or (high is not None and lo >= high):
                continue
            if (low is None or lo >= low) and (high is None or hi < high):
                total += f.entries
            else:
                ends.append(f)
        if ends:
            df = self.store.spark.read.schema(ENTRY).parquet(*(f"{self.store.path}/{f.path}" for f in ends)).select("okey")
            df = df if low is None else df.where(F.col("okey") >= F.lit(low))
            total += (df if high is None else df.where(F.col("okey") < F.lit(high))).count()
        return total

    def skip(self, n: int, db: str | None = None) -> DataFrame:
        """Counts in the manifest give the file; only that file is read."""
        for f in self.manifest.tree(db).files:
            if n < f.entries:
                return self.store.spark.read.schema(ENTRY).parquet(f"{self.store.path}/{f.path}").orderBy("okey").offset(n).limit(1)
            n -= f.entries
        return self.store.spark.createDataFrame([], ENTRY)


@dataclass
class Layer:
    """Staged operations of one (nested) transaction: batches by tree, cleared trees, manifest edits."""

    batches: dict[str | None, list[DataFrame]] = field(default_factory=dict)
    rows: dict[str | None, list[int]] = field(default_factory=dict)
    manifest: Manifest = None  # type: ignore[assignment]
    wrote: list[list[str | None]] | None = field(default_factory=list)
    #: Batches whose keys are too many for the manifest: tree, rows with the keys, number of operations.
    logged: list[tuple[str | None, DataFrame, int]] = field(default_factory=list)


class WriteTxn(View):
    """Staged batches over a version; nested transactions are layers."""

    def __init__(self, store: Store, base: Manifest):
        self.store, self.base = store, base
        self.layers = [Layer(manifest=base.child())]
        self.done = self.broken = False
        self._seq = 0
        self._staged_in: list[str] = []

    @property
    def manifest(self) -> Manifest:
        return self.layers[-1].manifest

    @property
    def id(self) -> int:
        return self.manifest.version

    def _check(self) -> None:
        if self.done or self.broken:
            raise StoreError(Code.BAD_TRANSACTION, "it is over" if self.done else "a write failed; only abort is left")

    # --- databases ----------------------------------------------------------------------------------------------------
    def db(self, name: str, order: str = ord_.BYTES, create: bool = True, prefix_keys: bool = False) -> str:
        """Open or create a sub-database; its order is fixed for ever."""
        self._check()
        if order in ord_.WIDTH and prefix_keys:
            raise StoreError(Code.INVALID_ARGUMENT, "integer keys have no prefix compression")
        if order not in ord_.ORDERS:
            raise StoreError(Code.INVALID_ARGUMENT, order)
        trees = self.manifest.trees
        if name in trees:
            if trees[name].order != order:
                raise StoreError(Code.INCOMPATIBLE, f"{name!r} has the order {trees[name].order}")
            return name
        if not create:
            raise StoreError(Code.NOT_FOUND, name)
        if len(trees) >= self.store.options.max_dbs:
            raise StoreError(Code.TOO_MANY_DBS)
        trees[name] = Tree(order, None, prefix_keys)
        return name

    def clear(self, db: str | None = None) -> None:
        """Empty a tree; no data is read. Its order stays."""
        self._check()
        tree = self.manifest.tree(db)
        tree.files = []
        for layer in self.layers:  # what was staged before is gone with the rest
            layer.batches.pop(db, None)
            layer.rows.pop(db, None)
        self._note(db, None)

    def drop(self, db: str | None) -> None:
        """Remove a sub-database; the main tree is emptied instead."""
        self.clear(db)
        if db is not None:
            del self.manifest.trees[db]

    # --- batches ------------------------------------------------------------------------------------------------------
    def _note(self, db: str | None, keys: Iterable[bytes] | None) -> None:
        """What this transaction wrote, for optimistic readers."""
        layer = self.layers[-1]
        if layer.wrote is None:
            return
        layer.wrote += [[db or "", None]] if keys is None else [[db or "", k.hex()] for k in keys]
        if len(layer.wrote) + sum(n for *_, n in layer.logged) > LOGGED_KEYS:
            layer.wrote = None

    def _fail(self, code: Code, message: str) -> None:
        self.broken = True
        raise StoreError(code, message)

    def stage(self, ops: DataFrame, db: str | None = None) -> None:
        """Stage ``ops(seq, op, key, value)``, in the order of seq, after what was staged before.

        op is one of upsert, insert_unique, update_only, erase. Null or oversized keys and values break the
        transaction, as a failing write does. The batch is written aside first, so ``ops`` runs once.
        """
        self._check()
        ops, folder = materialize(ops.select("seq", "op", "key", "value"), "staged")
        self._staged_in.append(folder)
        self._stage(ops, db)

    def _stage(self, ops: DataFrame, db: str | None) -> None:
        """Stage a batch that gives the same rows whenever it is read."""
        tree = self.manifest.tree(db)
        width = ord_.WIDTH.get(tree.order)
        n = F.octet_length("key")
        bad = F.col("key").isNull() | (n < 1) | (n > ord_.MAX_KEY) | ((F.col("op") != "erase") & (F.col("value").isNull() | (F.octet_length("value") > ord_.MAX_VALUE)))
        if width:
            bad = bad | (n != width)
        bad = bad | ~F.col("op").isin(*mutate.OPS)
        seen = ops.agg(F.count(F.lit(1)).alias("n"), F.max(bad).alias("bad"), F.max("seq").alias("last"), F.min("seq").alias("first")).first()
        if not seen.n:
            return
        if seen.bad:
            self._fail(Code.INVALID_ARGUMENT, "a key or value is empty, too large, or has the wrong width")
        shifted = ops.select((F.col("seq") - seen.first + self._seq).alias("seq"), "op", ord_.encode(F.col("key"), tree.order).alias("okey"), "key", "value")
        self._seq += seen.last - seen.first + 1
        self.layers[-1].batches.setdefault(db, []).append(shifted)
        self.layers[-1].rows.setdefault(db, []).append(seen.n)
        if width and tree.width is None:
            tree.width = width
        if seen.n > INLINE_KEYS:
            self.layers[-1].logged.append((db, shifted.select("key"), seen.n))
            self._note(db, [])
        elif self.layers[-1].wrote is not None:
            self._note(db, {bytes(r.key) for r in ops.select("key").collect()})

    def _ops(self, rows: list[tuple[str, bytes, bytes | None]]) -> DataFrame:
        return self.store.spark.createDataFrame([(i, op, bytes(k), None if v is None else bytes(v)) for i, (op, k, v) in enumerate(rows)], "seq long, op string, key binary, value binary")

    def apply(self, rows: list[tuple[str, bytes, bytes | None]], db: str | None = None) -> list[bool]:
        """Stage a small ordered batch; returns what each operation says (False: refused)."""
        self._check()
        tree = self.manifest.tree(db)
        for op, k, v in rows:
            try:
                ord_.check_key(k, tree.order, tree.width)
                ord_.check_value(v or b"")
            except StoreError as e:
                self._fail(e.code, str(e))
        ops = self._ops(rows)
        base = self.entries(db).select(F.col("key").alias("key"))
        done = mutate.outcomes(base, ops, "key").orderBy("seq").select("done").collect()
        self._stage(ops, db)
        return [r.done for r in done]

    def put(self, key: bytes, value: bytes, db: str | None = None, mode: str = "upsert") -> bool:
        return self.put_many([(key, value)], db, mode)[0]

    def put_many(self, pairs: list[tuple[bytes, bytes]], db: str | None = None, mode: str = "upsert") -> list[bool]:
        return self.apply([(mode, k, v) for k, v in pairs], db)

    def reserve(self, key: bytes, value: bytes, db: str | None = None, mode: str = "upsert") -> None:
        """A put that raises where put says False."""
        if not self.put(key, value, db, mode):
            raise StoreError(Code.KEY_EXISTS if mode == "insert_unique" else Code.NOT_FOUND, key.hex())

    def erase(self, key: bytes, db: str | None = None) -> bool:
        return self.apply([("erase", key, None)], db)[0]

    def erase_many(self, keys: list[bytes], db: str | None = None) -> list[bool]:
        return self.apply([("erase", k, None) for k in keys], db)

    def append(self, batch: DataFrame, db: str | None = None) -> None:
        """Bulk load of ``batch(seq, key, value)`` whose keys ascend in seq and lie above all others: new files, no merge."""
        self._check()
        tree = self.manifest.tree(db)
        encoded = batch.select("seq", ord_.encode(F.col("key"), tree.order).alias("okey"), "key", "value")
        # keys that were staged are written out first: an append is compared with all that is there
        self._flush(db)
        top = max((f.bounds[1] for f in tree.files), default=None)
        try:
            mutate.check_append(encoded, "okey", "seq", top)
        except StoreError as e:
            self._fail(e.code, str(e))
        tree.files = tree.files + self.store.write_files(encoded)
        self._note(db, None)

    # --- what the transaction sees ---------------------------------------------------------------------------------------
    def _staged(self, db: str | None) -> DataFrame | None:
        out = None
        for layer in self.layers:
            for batch in layer.batches.get(db, []):
                out = batch if out is None else out.unionByName(batch)
        return out

    def entries(self, name: str | None, lo: bytes | None = None, hi: bytes | None = None) -> DataFrame:
        tree = self.manifest.tree(name)
        base, ops = self.store.scan(self.manifest, name, lo, hi), self._staged(name)
        if ops is None:
            return base
        ops = ops if lo is None else ops.where(F.col("okey") >= F.lit(lo))
        ops = ops if hi is None else ops.where(F.col("okey") < F.lit(hi))
        merged = mutate.fold(base.select("okey", "value"), ops, "okey", "value")
        return merged.select("okey", ord_.encode(F.col("okey"), tree.order).alias("key"), "value")

    def _flush(self, name: str | None) -> None:
        """Fold what is staged for a tree into new files, in place of those it touches."""
        ops = self._staged(name)
        if ops is None:
            return
        tree = self.manifest.tree(name)
        touched = self._touched(tree, ops) if tree.files else []
        base = self.store.spark.read.schema(ENTRY).parquet(*(f"{self.store.path}/{f.path}" for f in touched)) if touched else self.store.spark.createDataFrame([], ENTRY)
        merged = mutate.fold(base.select("okey", "value"), ops, "okey", "value").select("okey", ord_.encode(F.col("okey"), tree.order).alias("key"), "value")
        # each touched file's stretch is written by itself, so that ranges stay disjoint from those of kept files
        new = self.store.write_files(merged, sum(f.entries for f in touched) + self._count_staged(name), [f.bounds[0] for f in touched])
        tree.files = sorted([f for f in tree.files if f not in touched] + new, key=lambda f: f.bounds)
        for layer in self.layers:
            layer.batches.pop(name, None)
            layer.rows.pop(name, None)

    def _count_staged(self, name: str | None) -> int:
        return sum(n for layer in self.layers for n in layer.rows.get(name, []))

    def _touched(self, tree: Tree, ops: DataFrame) -> list[File]:
        """Files in whose stretch (from their first key to the next file's) some operation falls."""
        stretch = stretch_of([f.bounds[0] for f in tree.files])
        hit = {r.i for r in ops.select(stretch("okey").alias("i")).distinct().collect()}  # a number for each file at most
        return [f for i, f in enumerate(tree.files) if i in hit]

    def rewrite(self, name: str | None, files: list[File]) -> None:
        """Merge runs of neighbouring files into dense ones."""
        tree = self.manifest.tree(name)
        run: list[File] = []
        out: list[File] = []
        for f in [*tree.files, None]:
            if f is not None and f in files:
                run.append(f)
                continue
            if len(run) > 1:
                df = self.store.spark.read.schema(ENTRY).parquet(*(f"{self.store.path}/{x.path}" for x in run))
                out += self.store.write_files(df, sum(x.entries for x in run))
            else:
                out += run
            run = []
            if f is not None:
                out.append(f)
        tree.files = out

    # --- ends ---------------------------------------------------------------------------------------------------------------
    @contextmanager
    def nested(self):
        """A savepoint: folded into the parent on return, dropped on an exception."""
        self._check()
        depth = len(self.layers)
        parent = self.manifest
        copy = mf.parse(parent.body())
        held = [({k: list(v) for k, v in layer.batches.items()}, {k: list(v) for k, v in layer.rows.items()}) for layer in self.layers]
        self.layers.append(Layer(manifest=copy, wrote=None if self.layers[-1].wrote is None else []))
        try:
            yield self
        except BaseException:
            del self.layers[depth:]
            for layer, (batches, rows) in zip(self.layers, held):
                layer.batches, layer.rows = batches, rows
            raise
        child = self.layers.pop()
        self.layers[-1].logged += child.logged
        for name, batches in child.batches.items():
            self.layers[-1].batches.setdefault(name, []).extend(batches)
            self.layers[-1].rows.setdefault(name, []).extend(child.rows[name])
        self.layers[-1].manifest = child.manifest
        if child.wrote is None or self.layers[-1].wrote is None:
            self.layers[-1].wrote = None
        else:
            self.layers[-1].wrote += child.wrote

    def commit(self) -> int:
        self._check()
        names = {n for layer in self.layers for n in layer.batches}
        for name in sorted(names, key=lambda n: n or ""):
            if name is None or name in self.manifest.trees:
                self._flush(name)
        m = self.manifest
        m.wrote = self.layers[-1].wrote
        if m.all_trees() == self.base.all_trees():
            self.abort()
            return self.base.version  # nothing changed: no new version
        if m.wrote is not None:
            m.logs = [self._log_keys(*x) for x in self.layers[-1].logged]
        self.store.publish(m)
        self.abort()
        return m.version

    def _log_keys(self, db: str | None, keys: DataFrame, n: int) -> list:
        folder = f"logs/{uuid.uuid4().hex}"
        keys.distinct().write.parquet(f"{self.store.path}/{folder}")
        return [db or "", folder, n]

    def abort(self) -> None:
        """Drop what is staged; files written meanwhile are reclaimable."""
        self.done = True
        for folder in self._staged_in:
            drop_folder(self.store.spark, folder)
        self._staged_in = []


def stretch_of(firsts: list[bytes]):
    """A column function: number of the last of these keys (a file's first each, in order) that is not above a key, 0 if all are."""
    starts = np.array(firsts, dtype=object)

    @pandas_udf(IntegerType())
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(starts, keys.to_numpy(dtype=object), side="right") - 1, 0).astype(np.int32))

    return number


def digest_of(path: str, sync: bool = False) -> str:
    h = xxhash.xxh3_64()
    with open(path, "rb") as f:
        if sync:
            os.fsync(f.fileno())
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()
