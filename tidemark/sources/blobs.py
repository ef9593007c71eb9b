"""Blobs: payloads appended to a tar archive, an index of them in a store's tree.

The archive is the truth: the index can be brought up to date with it or rebuilt from it. An index entry is JSON
with offset, size, member name, XXH3-64 digest and whether that is known; a mark says up to where the archive is
indexed. Erasing takes only the index entry.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError
from tidemark.functions.order import BYTES
from tidemark.operators.mutate import last_writers
from tidemark.plans.store import Store
from tidemark.session import materialize
from tidemark.sources import tar

MARK = b"indexed_up_to"
ENTRY = "offset long, size long, name string, digest string, known boolean"


class BlobStorage:
    def __init__(self, store: Store, archive: str, name: str = "blobs"):
        self.store, self.archive, self.db, self.meta = store, archive, name, f"{name}/meta"
        if not os.path.exists(archive):
            open(archive, "wb").close()
        with store.read() as s:
            there = s.has_db(self.db)
        if not there:
            with store.write() as t:
                t.db(self.db, BYTES), t.db(self.meta, BYTES)
                t.put(MARK, b"0", self.meta)
        self._repair()

    # --- the archive's end --------------------------------------------------------------------------------------------
    def _end(self, start: int = 0) -> int:
        """Where the next header goes, walking from a header's place."""
        end = start
        for m in tar.walk(self.archive, start):
            end = m.offset + tar.padded(m.size)
        return end

    @property
    def mark(self) -> int:
        with self.store.read() as s:
            return int(s.at(MARK, self.meta))

    def _repair(self) -> None:
        """Cut off a torn tail; an archive that ends before what is indexed is damaged."""
        end = self._end()
        if end < self.mark:
            raise StoreError(Code.CORRUPTED, f"{self.archive} ends at {end}, indexed up to {self.mark}")
        with open(self.archive, "r+b") as f:
            f.truncate(end)

    # --- writing --------------------------------------------------------------------------------------------------------
    def put_many(self, blobs: list[tuple[bytes, str, bytes]]) -> None:
        """Append ``(key, member name, payload)`` and index them; payloads are on disk before the index names them."""
        mark = self.mark
        if os.path.getsize(self.archive) < mark:
            raise StoreError(Code.CORRUPTED, f"{self.archive} is shorter than what is indexed")
        at, rows = self._end(mark), []
        if at > mark:
            self.catch_up()  # members of a writer that did not get to index them
        with open(self.archive, "r+b") as f:
            f.seek(at)
            f.truncate()
            for key, name, payload in blobs:
                f.write(tar.header(name, len(payload)) + payload + bytes(tar.padded(len(payload)) - len(payload)))
                rows.append(("upsert", key, self._entry(at + tar.BLOCK, len(payload), name, xxhash.xxh3_64_hexdigest(payload))))
                at += tar.BLOCK + tar.padded(len(payload))
            f.flush()
            os.fsync(f.fileno())
        with self.store.write() as t:
            t.stage(t._ops(rows), self.db)
            t.put(MARK, str(at).encode(), self.meta)

    def put(self, key: bytes, name: str, payload: bytes) -> None:
        self.put_many([(key, name, payload)])

    @staticmethod
    def _entry(offset: int, size: int, name: str, digest: str | None) -> bytes:
        return json.dumps({"offset": offset, "size": size, "name": name, "digest": digest, "known": digest is not None}).encode()

    def finalize(self) -> None:
        """End the archive as other tools expect it; later puts overwrite the end."""
        end = self._end(self.mark)
        with open(self.archive, "r+b") as f:
            f.seek(end)
            tar.finish(f)
            os.fsync(f.fileno())

    def erase(self, key: bytes) -> bool:
        with self.store.write() as t:
            return t.erase(key, self.db)

    # --- reading --------------------------------------------------------------------------------------------------------
    def find(self, key: bytes) -> dict | None:
        with self.store.read() as s:
            raw = s.get(key, self.db)
        return None if raw is None else json.loads(raw)

    def contains(self, key: bytes) -> bool:
        return self.find(key) is not None

    def at(self, key: bytes) -> dict:
        found = self.find(key)
        if found is None:
            raise StoreError(Code.NOT_FOUND, key.hex())
        return found

    def get(self, key: bytes) -> bytes:
        e = self.at(key)
        return tar.read_at(self.archive, e["offset"], e["size"])

    def find_many(self, keys: list[bytes]) -> list[dict | None]:
        with self.store.read() as s:
            return [None if v is None else json.loads(v) for v in s.find_many(keys, self.db)]

    def index(self) -> DataFrame:
        """The index as of now, written aside, so that it outlives the version it was read from."""
        with self.store.read() as s:
            entries = s.entries(self.db).select("key", F.from_json(F.decode("value", "UTF-8"), ENTRY).alias("e"))
            return materialize(entries.select("key", "e.*"), "blob-index")[0]

    def for_each_key(self, fn: Callable[[bytes], bool], prefix: bytes = b"") -> int:
        """Call ``fn`` with keys in order until it says False; returns how many were visited."""
        n = 0
        with self.store.read() as s:
            for r in s.prefix(prefix, self.db).select("key").toLocalIterator():
                n += 1
                if fn(bytes(r.key)) is False:
                    break
        return n

    def list(self) -> DataFrame:
        """The archive's members, whatever the index says."""
        return tar.members(self.store.spark, self.archive, payload=False).drop("payload", "archive")

    def verify(self) -> DataFrame:
        """``(key, ok)``: payload digests against the index, read by the executors; true where no digest is known."""
        archive = self.archive

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                same = [not known or xxhash.xxh3_64_hexdigest(tar.read_at(archive, o, n)) == d for o, n, d, known in zip(pdf["offset"], pdf["size"], pdf["digest"], pdf["known"])]
                yield pd.DataFrame({"key": pdf["key"], "ok": same})

        return self.index().mapInPandas(run, "key binary, ok boolean")

    # --- index from archive -----------------------------------------------------------------------------------------------
    def catch_up(self) -> int:
        """Index members past the mark under their names, digest unknown; returns how many."""
        start = self.mark
        new = tar.members(self.store.spark, self.archive, payload=False, start=start)
        return self._index(new, F.encode("name", "UTF-8"), start)

    def rebuild_index(self, key_of: Callable[[pd.Series], pd.Series] | None = None) -> int:
        """Index all members anew: keys from ``key_of`` (names to BINARY, an Arrow function) or the names; of equal keys the later member counts."""
        every = tar.members(self.store.spark, self.archive, payload=False)
        key = F.encode("name", "UTF-8") if key_of is None else F.pandas_udf(key_of, "binary")(F.col("name"))
        return self._index(every, key)

    def _index(self, found: DataFrame, key, start: int | None = None) -> int:
        """Enter members; without a start in place of all that was entered, in the same commit."""
        latest = last_writers(found.select(key.alias("key"), "name", "offset", "size"), "key", "offset")
        value = F.encode(F.to_json(F.struct("offset", "size", "name", F.lit(False).alias("known"))), "UTF-8")
        ops, _ = materialize(latest.select(F.col("offset").alias("seq"), F.lit("upsert").alias("op"), "key", value.alias("value")), "blob-entries")
        with self.store.write() as t:
            if start is None:
                t.clear(self.db)
            t.stage(ops, self.db)
            t.put(MARK, str(self._end(start or 0)).encode(), self.meta)
        return ops.count()
