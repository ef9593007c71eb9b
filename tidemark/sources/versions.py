"""A stream of a store's commits: one row for each version, offset = version.

``spark.readStream.format("tidemark_versions").load(path)`` gives ``(version, commit_id, parent_id, entries, wrote)``
with ``wrote`` as ``array<struct<db string, key binary>>``, null if unknown. Keys of large batches are not listed: such a
batch shows as its database with a null key, as a cleared one does.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.errors import StoreError
from tidemark.plans import manifest as mf

SCHEMA = "version bigint, commit_id string, parent_id string, entries bigint, wrote array<struct<db string, key binary>>"


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, path: str, start: int):
        self.path, self.start = path, start

    def initialOffset(self) -> dict:
        return {"version": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._rows(start["version"], None))
        return iter(rows), {"version": rows[-1][0] + 1 if rows else start["version"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["version"], end["version"])

    def _rows(self, lo: int, hi: int | None) -> Iterator[tuple]:
        for v in mf.versions(self.path):
            if v < lo or hi is not None and v >= hi:
                continue
            try:
                m = mf.load(self.path, v)
            except StoreError:
                continue  # vacuumed meanwhile
            wrote = None if m.wrote is None else [(db, None if k is None else bytes.fromhex(k)) for db, k in m.wrote] + [(db, None) for db, *_ in m.logs]
            yield v, m.commit_id, m.parent_id, sum(t.entries for t in m.all_trees().values()), wrote

    def commit(self, end: dict) -> None:
        return None


class VersionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark_versions"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options["path"].removeprefix("file://"), int(self.options.get("start", 0)))
