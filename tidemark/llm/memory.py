"""Bounded memory around Python functions: small Arrow batches, and workers that give memory back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and Python. The JVM and the worker each hold a few copies of one.
BATCH_BYTES = 4 << 20
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch to ``BATCH_BYTES`` if it is larger."""
    found = spark.conf.get(_CONF)
    if not found.rstrip("b").isdigit() or not 0 < int(found.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_CONF, str(BATCH_BYTES))


#: Characters of text that a function holds the work of at a time, unless one text is longer.
HELD_CHARS = 1 << 20


def slices(pdf: pd.DataFrame, column: str = "text") -> Iterator[pd.DataFrame]:
    """A batch in parts of about ``HELD_CHARS`` characters."""
    start = size = 0
    for i, text in enumerate(pdf[column]):
        size += len(text or "")
        if size >= HELD_CHARS:
            yield pdf.iloc[start : i + 1]
            start, size = i + 1, 0
    if start < len(pdf):
        yield pdf.iloc[start:]


def give_back() -> None:
    """Return freed memory to the system: a reused worker may idle while others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # not glibc


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInPandas or mapInArrow, fed with small batches and giving memory back at its end."""
    if (session := SparkSession.getActiveSession()) is not None:
        small_batches(session)

    def leaner(parts: Iterator) -> Iterator:
        yield from run(parts)
        give_back()

    return leaner
