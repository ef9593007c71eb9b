"""The folder that driver and executors share, and tables written there.

Everything that must outlive a task (cut lineage, model files, archives) goes under the folder that the
session names in ``spark.checkpoint.dir``. Only where that is unset and all runs in one process, as in tests, a
folder is chosen here; on a cluster executors would each write to a disk of their own, so that is refused.
"""

from __future__ import annotations

import atexit
import os
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder (one machine, as in tests).
UNSET_DIR = "file:///tmp/checkpoints/tidemark"
_OWN: dict[str, SparkSession] = {}
_OPEN = threading.local()
#: Makes each query drop its shuffle files as it ends; otherwise they stay until the driver collects its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FREEING: dict[int, list] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        base = UNSET_DIR
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh, empty folder in the shared one; removed when this driver ends."""
    uri = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    path, fs = _fs(spark, uri)
    fs.mkdirs(path)
    _OWN[uri] = spark
    if getattr(_OPEN, "scratch", None) is not None:
        _OPEN.scratch.append(uri)
    return uri


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Remove a folder made by :func:`new_folder`."""
    path, fs = _fs(spark, uri)
    fs.delete(path, True)
    _OWN.pop(uri, None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that this thread makes inside are removed at the end, but for those entered in the list that is given."""
    outer, made = getattr(_OPEN, "scratch", None), []
    kept: list[str] = []
    _OPEN.scratch = made
    try:
        yield kept
    finally:
        _OPEN.scratch = outer
        for uri in made:
            if uri in kept:
                if outer is not None:
                    outer.append(uri)
            elif uri in _OWN:
                drop_folder(spark, uri)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """The session's queries inside drop their shuffle files as they end: for jobs whose results are written or collected.

    A DataFrame that is executed again inside computes its shuffles again. Blocks may nest and run side by side.
    """
    key = spark._jsparkSession.hashCode()
    with _LOCK:
        held = _FREEING.setdefault(key, [0, spark.conf.get(_FREE, None)])
        held[0] += 1
        spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if not held[0]:
                del _FREEING[key]
                if held[1] is None:
                    spark.conf.unset(_FREE)
                else:
                    spark.conf.set(_FREE, held[1])


@atexit.register
def _sweep() -> None:
    for uri, spark in list(_OWN.items()):
        try:
            if spark.sparkContext._jsc is not None:
                drop_folder(spark, uri)
        except Exception:  # the JVM may have gone first
            continue


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    uri = new_folder(spark, label)
    df.write.mode("overwrite").parquet(uri)
    return spark.read.schema(df.schema).parquet(uri), uri


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder from a worker: by path if the folder is mounted, else through Arrow's file systems."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        if "w" in mode:
            os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        return open(parsed.path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_stream(path)


def move_shared(src: str, dst: str) -> None:
    """Put a finished file in place; a repeated task replaces the same content."""
    a, b = urlparse(src), urlparse(dst)
    if a.scheme in ("", "file"):
        os.replace(a.path, b.path)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(src)
    system.move(path, fs.FileSystem.from_uri(dst)[1])
