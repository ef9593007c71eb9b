"""Integrity and inspection: the store's state as DataFrames, and checks as queries over it."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import manifest as mf

FILES = "tree string, position int, path string, lo string, hi string, entries long, bytes long, digest string"


def _over_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    return rows.repartition(max(1, min(len(paths), spark.sparkContext.defaultParallelism)))


def file_digests(spark: SparkSession, root: str, paths: list[str], sync: bool = False) -> DataFrame:
    """``(path, digest)``: XXH3-64 of each file, streamed by the executors; with ``sync`` files are on disk afterwards."""
    from tidemark.plans.store import digest_of

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "digest": [digest_of(f"{root}/{p}", sync) if os.path.exists(f"{root}/{p}") else None for p in pdf["path"]]})

    return _over_files(spark, paths).mapInPandas(run, "path string, digest string")


def copy_files(spark: SparkSession, src: str, dst: str, paths: list[str]) -> None:
    """Copy files below one folder to the same places below another, by the executors; a repeated task replaces its copies."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for pdf in parts for p in pdf["path"]):
            tmp = f"{dst}/{path}.{TaskContext.get().taskAttemptId()}.tmp"
            os.makedirs(os.path.dirname(tmp), exist_ok=True)
            shutil.copyfile(f"{src}/{path}", tmp)
            os.replace(tmp, f"{dst}/{path}")
            yield pd.DataFrame({"path": [path]})

    if paths:
        _over_files(spark, paths).mapInPandas(run, "path string").count()


def measure(spark: SparkSession, root: str, paths: list[str], sync: bool) -> DataFrame:
    """``(path, n, lo, hi, bytes, digest)`` of sorted files, in one pass; with ``sync`` they are on disk afterwards."""
    from tidemark.plans.store import digest_of

    def end(f: pq.ParquetFile, group: int, place: int) -> bytes:
        return f.read_row_group(group, columns=["okey"]).column(0)[place].as_py()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for pdf in parts for p in pdf["path"]):
            with pq.ParquetFile(f"{root}/{path}") as f:
                n = f.metadata.num_rows
                lo, hi = (end(f, 0, 0), end(f, f.metadata.num_row_groups - 1, -1)) if n else (None, None)
            yield pd.DataFrame({"path": [path], "n": [n], "lo": [lo], "hi": [hi], "bytes": [os.path.getsize(f"{root}/{path}")], "digest": [digest_of(f"{root}/{path}", sync)]})

    return _over_files(spark, paths).mapInPandas(run, "path string, n long, lo binary, hi binary, bytes long, digest string")


def key_order(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """``(path, n, lo, hi, bad)``: rows and bounds of each file, and how many keys are not above the one before them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for pdf in parts for p in pdf["path"]):
            n, bad, lo, hi, last = 0, 0, None, None, None
            with pq.ParquetFile(f"{root}/{path}") as f:
                for batch in f.iter_batches(columns=["okey"]):
                    for key in batch.column(0).to_pylist():
                        bad += last is not None and key <= last
                        lo, hi, last = key if lo is None else min(lo, key), key if hi is None else max(hi, key), key
                    n += batch.num_rows
            yield pd.DataFrame({"path": [path], "n": [n], "lo": [lo], "hi": [hi], "bad": [int(bad)]})

    return _over_files(spark, paths).mapInPandas(run, "path string, n long, lo binary, hi binary, bad long")


def row_groups(store, m: mf.Manifest | None = None) -> DataFrame:
    """What the footers of the files say: ``(tree, path, row_group, rows, bytes, compressed, lo, hi)``, bounds of okey as far as statistics have them."""
    root, listed = store.path, files(store, m)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for tree, path in zip(pdf["tree"], pdf["path"]):
                with pq.ParquetFile(f"{root}/{path}") as f:
                    at, rows = f.schema_arrow.names.index("okey"), []
                    for i in range(f.metadata.num_row_groups):
                        group = f.metadata.row_group(i)
                        columns = [group.column(c) for c in range(group.num_columns)]
                        stats = columns[at].statistics
                        lo, hi = (stats.min, stats.max) if stats is not None and stats.has_min_max else (None, None)
                        rows.append((tree, path, i, group.num_rows, group.total_byte_size, sum(c.total_compressed_size for c in columns), lo, hi))
                yield pd.DataFrame(rows, columns=["tree", "path", "row_group", "rows", "bytes", "compressed", "lo", "hi"])

    return listed.select("tree", "path").mapInPandas(run, "tree string, path string, row_group int, rows long, bytes long, compressed long, lo binary, hi binary")


def files(store, m: mf.Manifest | None = None) -> DataFrame:
    m = m or store.manifest
    rows = [(name or "", i, f.path, f.lo, f.hi, f.entries, f.bytes, f.digest) for name, t in m.all_trees().items() for i, f in enumerate(t.files)]
    return store.spark.createDataFrame(rows, FILES)


def trees(store, m: mf.Manifest | None = None) -> DataFrame:
    m = m or store.manifest
    rows = [(n or "", t.order, len(t.files), t.entries, t.bytes, t.bytes // t.entries if t.entries else 0) for n, t in m.all_trees().items()]
    return store.spark.createDataFrame(rows, "tree string, order string, files int, entries long, bytes long, bytes_per_entry long")


def metas(store) -> DataFrame:
    """Every version that is kept."""
    loaded = [mf.load(store.path, v) for v in mf.versions(store.path)]
    rows = [(m.version, m.commit_id, m.parent_id, m.checksum, sum(t.entries for t in m.all_trees().values()), mf.complete(store.path, m)) for m in loaded]
    return store.spark.createDataFrame(rows, "version long, commit_id string, parent_id string, checksum string, entries long, whole boolean")


def stats(store) -> dict:
    """Sizes, versions, readers and what a vacuum would free."""
    m = store.manifest
    old, garbage = store.reclaimable()
    pins = store.pins()
    oldest = min(pins, default=m.version)
    return {
        "version": m.version, "store_id": m.store_id, "trees": len(m.trees) + 1, "files": len(m.paths()),
        "bytes": sum(t.bytes for t in m.all_trees().values()), "entries": sum(t.entries for t in m.all_trees().values()),
        "versions": len(mf.versions(store.path)), "expired_versions": len(old), "readers": sum(pins.values()), "oldest_pinned": oldest,
        "reader_lag": m.version - oldest, "reclaimable_bytes": sum(os.path.getsize(f"{store.path}/{p}") for p in garbage),
        "rolled_back": store.rolled_back, "max_key_size": store.max_key_size, "sync": store.options.sync,
    }


def readers(store) -> DataFrame:
    return store.spark.createDataFrame(sorted(store.pins().items()), "snapshot long, readers int")


def free_list(store) -> DataFrame:
    """Reclaimable files with the last kept version that names them (-1: none), newest first."""
    _, garbage = store.reclaimable()
    last = {p: v for v in mf.versions(store.path) for p in mf.load(store.path, v).paths()}
    rows = [(p, os.path.getsize(f"{store.path}/{p}"), last.get(p, -1)) for p in garbage]
    return store.spark.createDataFrame(rows, "path string, bytes long, retired long").orderBy(F.desc("retired"), "path")


def file_map(store) -> DataFrame:
    """Runs of files by tree, in the order of the manifest: ``(tree, first, last, n)``.

    The manifest lists trees one after the other, so a tree's files are one run; only trees are numbered over all.
    """
    rows = [(name or "", t) for name, t in store.manifest.all_trees().items() if t.files]
    ends = list(accumulate(len(t.files) for _, t in rows))
    return store.spark.createDataFrame([(name, end - len(t.files), end - 1, len(t.files)) for (name, t), end in zip(rows, ends)], "tree string, first long, last long, n long")


def preview(store, path: str, n: int = 10) -> DataFrame:
    return store.spark.read.parquet(f"{store.path}/{path}").limit(n)


def check(store, digests: bool = True) -> list[str]:
    """What is wrong with the newest version, nothing if all is well.

    Keys ascend within files and are unique, files' ranges are disjoint and hold their rows, counts are right,
    every file is there unchanged and belongs to one tree.
    """
    m, wrong = store.manifest, []
    owners: dict[str, str] = {}
    for name, t in m.all_trees().items():
        label = name or "main"
        for a, b in zip(t.files, t.files[1:]):
            if a.bounds[1] >= b.bounds[0]:
                wrong.append(f"{label}: {a.path} reaches into {b.path}")
        for f in t.files:
            if f.path in owners:
                wrong.append(f"{f.path} is in {owners[f.path]} and {label}")
            owners[f.path] = label
            if not os.path.exists(f"{store.path}/{f.path}"):
                wrong.append(f"{label}: {f.path} is missing")
    there = {p for p in owners if os.path.exists(f"{store.path}/{p}")}
    if digests and there:
        listed = {f.path: f.digest for t in m.all_trees().values() for f in t.files}
        wrong += [f"{r.path}: digest differs" for r in file_digests(store.spark, store.path, sorted(there)).collect() if r.digest != listed[r.path]]
        if wrong:
            return wrong
    if there:
        seen = {r.path: r for r in key_order(store.spark, store.path, sorted(there)).collect()}  # a row for each file
        for t in m.all_trees().values():
            for f in t.files:
                r = seen.get(f.path)
                if r is None or (r.n, bytes(r.lo).hex(), bytes(r.hi).hex()) != (f.entries, f.lo, f.hi):
                    wrong.append(f"{f.path}: rows are not what the manifest says")
                elif r.bad:
                    wrong.append(f"{f.path}: {r.bad} keys are not above the one before them")
    return wrong
