"""ustar archives: a batch data source of members, writers, and the header format.

``spark.read.format("ustar").load(folder_or_file)`` gives ``(archive, name, offset, size, payload)`` for regular
members; a partition is at most ``split`` bytes of one archive (option, 128 MB unless given). Reading stops at a zero block, a header whose checksum or size is wrong, or a
payload that is cut short. Columns that are not asked for cost no reading: option ``payload=false`` leaves them null.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.errors import Code, StoreError

BLOCK, RECORD = 512, 10 * 1024
MAX_NAME, MAX_SIZE = 100, 8 * (1 << 30) - 1
SCHEMA = "archive string, name string, offset bigint, size bigint, payload binary"


def checksum(block: bytes) -> int:
    """Sum of a header's bytes with its checksum field taken as spaces."""
    return sum(block[:148]) + 8 * 32 + sum(block[156:BLOCK])


def header(name: str, size: int, mtime: int = 0) -> bytes:
    """A ustar header of a regular member."""
    raw = name.encode()
    if not 1 <= len(raw) <= MAX_NAME:
        raise StoreError(Code.INVALID_ARGUMENT, f"a member's name has 1 to {MAX_NAME} bytes")
    if not 0 <= size <= MAX_SIZE:
        raise StoreError(Code.VALUE_TOO_LARGE, f"{size} bytes")
    # name, mode, uid, gid, size, mtime, checksum, kind, link name, magic and version, owner, group, device numbers, prefix
    fields = [raw.ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0", b"%011o\0" % size, b"%011o\0" % mtime, b" " * 8, b"0", bytes(100), b"ustar\x0000", bytes(32), bytes(32), b"0000000\0", b"0000000\0", bytes(167)]
    block = b"".join(fields)
    return block[:148] + b"%06o\0 " % checksum(block) + block[156:]


def parse(block: bytes) -> tuple[str, int, bytes] | None:
    """Name, size and kind of a header; None for a zero or damaged block."""
    if len(block) < BLOCK or not block.strip(b"\0"):
        return None
    try:
        if int(block[148:156].strip(b"\0 ") or b"x", 8) != checksum(block):
            return None
        size = int(block[124:136].strip(b"\0 ") or b"0", 8)
        name = block[:100].rstrip(b"\0").decode()
    except ValueError:
        return None
    return (name, size, block[156:157]) if 0 <= size <= MAX_SIZE else None


def padded(size: int) -> int:
    return -(-size // BLOCK) * BLOCK


@dataclass
class Member:
    name: str
    offset: int
    size: int


def headers(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, int, bytes]]:
    """Place, name, size and kind of members of any kind whose headers lie in [start, end); ``start`` is a header's place."""
    total = os.path.getsize(path)
    with open(path, "rb") as f:
        at = start
        while at + BLOCK <= total and (end is None or at < end):
            f.seek(at)
            found = parse(f.read(BLOCK))
            if found is None or at + BLOCK + found[1] > total:
                return
            yield at, *found
            at += BLOCK + padded(found[1])


def walk(path: str, start: int = 0, end: int | None = None) -> Iterator[Member]:
    """Regular members from a header position on; see the module on where it stops."""
    for at, name, size, kind in headers(path, start, end):
        if kind in (b"0", b"\0"):
            yield Member(name, at + BLOCK, size)


def read_at(path: str, offset: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read(size)


class _Archive(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], start: int, payload: bool, split: int):
        self.paths, self.start, self.payload, self.split = paths, start, payload, split

    def partitions(self) -> list[InputPartition]:
        """An archive that is longer than ``split`` is cut at headers, which only a walk can tell from payloads."""
        out: list[InputPartition] = []
        for p in self.paths:
            cuts = [self.start]
            if os.path.getsize(p) - self.start > self.split:
                for at, *_ in headers(p, self.start):
                    if at - cuts[-1] >= self.split:
                        cuts.append(at)
            out += [_Archive(p, a, b) for a, b in zip(cuts, [*cuts[1:], None])]
        return out

    def read(self, partition: _Archive) -> Iterator[tuple]:
        for m in walk(partition.path, partition.start, partition.end):
            yield partition.path, m.name, m.offset, m.size, read_at(partition.path, m.offset, m.size) if self.payload else None


class TarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ustar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        path = self.options.get("path", "").removeprefix("file://")
        paths = sorted(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".tar")) if os.path.isdir(path) else [path]
        return _Reader(paths, int(self.options.get("start", 0)), self.options.get("payload", "true").lower() != "false", int(self.options.get("split", 128 << 20)))


def members(spark: SparkSession, path: str, payload: bool = True, start: int = 0, split: int = 128 << 20) -> DataFrame:
    spark.dataSource.register(TarSource)
    return spark.read.format("ustar").option("payload", str(payload)).option("start", start).option("split", split).load(path)


def write_archives(df: DataFrame, folder: str) -> DataFrame:
    """``df(name, payload)`` as one archive for each partition; returns ``(archive, name, offset, size)``.

    A task writes under a temporary name and renames when done, so a repeated task replaces its archive.
    """
    folder = folder.removeprefix("file://")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/part-{TaskContext.get().partitionId():05d}.tar"
        tmp, rows = f"{path}.{TaskContext.get().taskAttemptId()}", []
        with open(tmp, "wb") as f:
            for pdf in parts:
                for name, payload in zip(pdf["name"], pdf["payload"]):
                    rows.append((path, name, f.tell() + BLOCK, len(payload)))
                    f.write(header(name, len(payload)) + payload + bytes(padded(len(payload)) - len(payload)))
            finish(f)
        os.replace(tmp, path)
        yield pd.DataFrame(rows, columns=["archive", "name", "offset", "size"])

    return df.select("name", "payload").mapInPandas(run, "archive string, name string, offset long, size long")


def finish(f) -> None:
    """Two zero blocks, then zeros to a whole record."""
    f.write(bytes(2 * BLOCK))
    f.write(bytes(-f.tell() % RECORD))
