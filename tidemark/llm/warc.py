"""WARC archives: writing with duplicate revisits and segmented records, reading with reassembly.

Writing: payloads are digested by Spark. Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the one
with the largest page_id becomes a response and the others revisits of it; all others are responses. Only rows of
that size meet the table of repeated digests, which is written first, so that Spark splits a digest with many rows.
Responses carry the payload in chunked transfer framing. A block over ``SEGMENT`` bytes is written as a first
record and continuation records. Each task writes its own archives (gzip, a member for each record) into the shared
folder under a temporary name and moves them into place when they are complete, so a repeated task only
replaces them. A record identifier is made of page_id, address, digest and, for equal rows, the copy's number:
such rows are counted, and their copies dealt out in runs of ``COPIES``, so identifiers are unique.

Reading: tasks stream through archives. Records in one piece are decoded at once. Segments are dealt by the
record identifier of their origin and sorted by segment number, so reassembly streams too and holds one record
at a time; it checks that the numbers are gapless and that the length is the total given by the last segment,
then undoes the chunked framing. A record that fails a check has no payload and says why in ``problem``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.memory import lean
from tidemark.session import materialize, move_shared, new_folder, open_shared

#: Smaller payloads are never revisits.
MIN_REVISIT = 1000
#: Largest block of one record, largest chunk of the transfer framing and size at which a task starts a new archive.
SEGMENT, CHUNK, ROLL = 32 << 10, 8 << 10, 1 << 30
#: Records of equal rows that one task writes for a row it gets.
COPIES = 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
RECORD = "kind string, record_id string, page_id long, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
PART = "origin string, segment int, total long, block binary"


def chunked(payload: bytes) -> bytes:
    """A body in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The body without chunked framing; ValueError if the framing is broken."""
    at, out = 0, []
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is cut off")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, copy: int = 0) -> Iterator[bytes]:
    """The WARC records of one page, packed; a revisit if ``refers_to`` names the record of a response."""
    own = record_id(page_id, url, digest, copy)
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    common = [("WARC-Date", DATE), ("WARC-Target-URI", quote(url or "urn:none", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", sha1), ("X-Page-Id", page_id)]
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to), *kind], HTTP)
        return
    block = HTTP + chunked(payload)
    if len(block) <= SEGMENT:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *kind], block)
        return
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    yield _record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1), *kind], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, url, digest, copy, k)), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def _planned(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest, top, copy, copies)``: what to write; top names the response that a row revisits."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    key = ["page_id", "url", "digest"]
    digested = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    groups = digested.where(F.col("bytes") >= MIN_REVISIT).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"), F.count(F.lit(1)).alias("n"))
    groups, _ = materialize(groups.where("n > 1 and top.page_id is not null").select("digest", "top"), "digests")
    repeated, _ = materialize(digested.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")

    rows = digested.withColumns({"copy": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    if not repeated.isEmpty():
        other = repeated.select(*(F.col(c).alias(f"{c}_2") for c in key), F.col("copies").alias("n_2"))
        same = F.lit(True)
        for c in key:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
        once = digested.join(other, same).groupBy(*key, "n_2").agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
        runs = once.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_2") - 1, F.lit(COPIES).cast("long"))))
        runs = runs.withColumn("copies", F.least(F.lit(COPIES), F.col("n_2") - F.col("copy"))).select(*rows.columns)
        rows = rows.join(other, same, "left_anti").unionByName(runs.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    met = rows.where(F.col("bytes") >= MIN_REVISIT).join(groups, "digest", "left")
    revisits = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("top.page_id")), F.col("top"))
    columns = ["page_id", "url", "payload", "digest", "copy", "copies"]
    small = rows.where(F.col("bytes") < MIN_REVISIT).select(*columns, F.lit(None).cast(groups.schema["top"].dataType).alias("top"))
    return met.select(*columns, revisits.alias("top")).unionByName(small)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """``pages(page_id, url, html)`` into archives below ``folder``; returns their paths.

    A null html is an empty payload. Rows without a page_id are responses unless a row with one has the same
    payload. Rows that repeat the largest page_id and payload are responses each, of which the one with the largest
    address is revisited. Equal rows are a record each. Other columns are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, made, out = f"{folder}/pages-{context.partitionId():05d}", [], None
        for part in parts:
            for page_id, url, body, digest, top, first, copies in _rows(part, "page_id", "url", "payload", "digest", "top", "copy", "copies"):
                ref = None if top is None else record_id(top["page_id"], top["url"], digest, 0)
                for copy in range(first, first + copies):
                    if out is None:
                        made.append(f"{name}-{len(made):03d}.warc.gz")
                        tmp, size = f"{made[-1]}.{context.taskAttemptId()}.tmp", 0
                        out = open_shared(tmp, "wb")
                        out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(made[-1])), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    for packed in records(page_id, url, body, digest, ref, copy):
                        out.write(packed)
                        size += len(packed)
                    if size > ROLL:
                        out.close()
                        move_shared(tmp, made[-1])
                        out = None
        if out is not None:
            out.close()
            move_shared(tmp, made[-1])
        yield pa.record_batch({"path": pa.array(made, pa.string())})

    return materialize(_planned(pages).mapInArrow(lean(run), "path string"), "archives")[0]


def _rows(part: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows one at a time: of a batch of large values only one is a Python object."""
    columns = [part.column(n) for n in names]
    for i in range(part.num_rows):
        yield tuple(c[i].as_py() for c in columns)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an unpacked archive as (fields, block); the fields' names in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("record is cut off")
        yield fields, block


def _row(kind: str, fields: dict[str, str], payload: bytes | None, keep: bool, problem: str | None = None) -> dict:
    page = fields.get("x-page-id")
    return {
        "kind": kind,
        "record_id": fields.get("warc-record-id"),
        "page_id": int(page) if page is not None else None,
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": None if payload is None else len(payload),
        "payload_digest": None if payload is None else hashlib.sha1(payload).hexdigest(),
        "payload": payload if keep else None,
        "problem": problem,
    }


def _whole(kind: str, fields: dict[str, str], block: bytes, keep: bool) -> dict:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return _row(kind, fields, None, keep, str(e))
    found = fields.get("warc-payload-digest", "")
    if found.startswith("sha1:") and base64.b32decode(found[5:]) != hashlib.sha1(payload).digest():
        return _row(kind, fields, None, keep, "digest differs")
    return _row(kind, fields, payload, keep)


def _frames(rows: Iterator[tuple[dict, int]], names: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of a few MB."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size > 4 << 20 or len(held) >= 10_000:
            yield _frame(held, names)
            held, size = [], 0
    yield _frame(held, names)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=names, dtype=object)
    return pdf.astype({c: "Int64" for c in ("page_id", "payload_bytes", "segment", "total") if c in names})


def read_archives(paths: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Archives in ``paths(path)`` to one row per response or revisit (columns ``RECORD``).

    Revisits have no payload of their own; see :func:`resolve`. Without ``keep_payload`` only sizes and digests
    are returned. An archive that is cut off or isn't WARC raises ValueError.
    """
    spark = paths.sparkSession
    names = [x.split()[0] for x in f"{RECORD}, {PART}".split(", ")]

    def rows(path: str) -> Iterator[tuple[dict, int]]:
        with open_shared(path, "rb") as raw, gzip.open(raw) as stream:
            for fields, block in parse(stream):
                kind = fields.get("warc-type")
                if kind == "response" and "warc-segment-number" not in fields:
                    yield (row := _whole(kind, fields, block, keep_payload)), 400 + len(row["payload"] or b"")
                elif kind == "revisit":
                    yield _row(kind, fields, None, False), 400
                elif kind in ("response", "continuation"):
                    total = fields.get("warc-segment-total-length")
                    part = {"origin": fields.get("warc-segment-origin-id", fields.get("warc-record-id")), "segment": int(fields["warc-segment-number"]), "total": int(total) if total else None, "block": block}
                    digest = fields.get("warc-payload-digest")
                    yield _row("segment", fields, None, False, digest) | part, 400 + len(block)

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for path in pdf["path"]:
                yield from _frames(rows(path), names)

    n = max(1, paths.count())
    found, _ = materialize(paths.repartition(n).mapInPandas(lean(scan), f"{RECORD}, {PART}"), "records")
    own = [x.split()[0] for x in RECORD.split(", ")]

    needed = ("origin", "segment", "total", "block", "page_id", "problem")

    def joined(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int]]:
        origin, held = None, []
        for part in parts:
            for row in (dict(zip(needed, x)) for x in _rows(part, *needed)):
                if row["origin"] != origin and held:
                    yield from whole(origin, held)
                    held = []
                origin = row["origin"]
                held.append(row)
        if held:
            yield from whole(origin, held)

    def whole(origin: str, held: list[dict]) -> Iterator[tuple[dict, int]]:
        """One record of its segments in order."""
        first, last = held[0], held[-1]
        fields = {"warc-record-id": origin, "warc-payload-digest": first["problem"] or ""} | ({} if first["page_id"] is None else {"x-page-id": str(first["page_id"])})
        block = b"".join(r["block"] for r in held)
        if [r["segment"] for r in held] != list(range(1, len(held) + 1)) or last["total"] is None:
            row = _row("response", fields, None, keep_payload, "segments are missing")
        elif len(block) != last["total"]:
            row = _row("response", fields, None, keep_payload, "total length differs")
        else:
            row = _whole("response", fields, block, keep_payload)
        yield row, 400 + len(row["payload"] or b"")

    def reassemble(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _frames(joined(parts), own):
            yield pa.RecordBatch.from_pandas(frame, schema=_ARROW, preserve_index=False)

    segments = found.where("kind = 'segment'").select(*needed)
    split = segments.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(lean(reassemble), RECORD)
    return found.where("kind <> 'segment'").select(*own).unionByName(split)


def resolve(found: DataFrame) -> DataFrame:
    """Records to ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``; revisits take size and digest from their response."""
    found, _ = materialize(found.drop("payload"), "resolved")
    responses = found.where("kind = 'response'")
    # identifiers are unique: a plain join, whose hot partitions (a response that many revisit) Spark splits
    named = responses.where(F.col("payload_bytes") >= MIN_REVISIT).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest"))
    revisits = found.where("kind = 'revisit'").select("page_id", "refers_to").join(named, "refers_to", "left")
    none = F.lit(None).cast("long")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none.alias("refers_to")).unionByName(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("to_page").alias("refers_to"))
    )


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Whole table ``pages``: page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written and read back."""
    paths = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), new_folder(spark, "warc"))
    return resolve(read_archives(paths, keep_payload=False))


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, max(page_id) AS largest FROM p WHERE octet_length(b) >= 1000 GROUP BY d)
SELECT page_id, octet_length(b) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id < largest OR (page_id IS NULL AND largest IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest OR (page_id IS NULL AND largest IS NOT NULL) THEN largest END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
