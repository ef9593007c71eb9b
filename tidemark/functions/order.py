"""Order-preserving key encodings: unsigned byte order of ``okey`` is the order of the tree.

Spark compares BINARY as unsigned bytes, shorter first, which is the byte order of keys. Reversed-byte order and
little-endian integer order become byte order of the reversed key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import Code, StoreError

BYTES, REVERSE, U32, U64 = "bytes", "reverse", "u32", "u64"
ORDERS = (BYTES, REVERSE, U32, U64)
#: Longest key, in bytes, and longest value that fits a BINARY cell.
MAX_KEY, MAX_VALUE = 996, (1 << 31) - 16
WIDTH = {U32: 4, U64: 8}


def reverse_bytes(key: Column) -> Column:
    """Bytes from last to first; by way of a one-byte character set, since reverse() on BINARY goes through UTF-8."""
    return F.encode(F.reverse(F.decode(key, "ISO-8859-1")), "ISO-8859-1")


def encode(key: Column, order: str) -> Column:
    return key if order == BYTES else reverse_bytes(key)


def encode_bytes(key: bytes, order: str) -> bytes:
    return key if order == BYTES else key[::-1]


def decode_bytes(okey: bytes, order: str) -> bytes:
    return encode_bytes(okey, order)  # each encoding is its own inverse


def big_endian(n: Column, width: int = 8) -> Column:
    """Non-negative integers (BIGINT or DECIMAL(20,0)) as fixed-width bytes that sort like the numbers."""
    return F.unhex(F.lpad(F.conv(n.cast("decimal(20,0)").cast("string"), 10, 16), 2 * width, "0"))


def little_endian(n: Column, width: int = 8) -> Column:
    return reverse_bytes(big_endian(n, width))


def integer_of(key: Column) -> Column:
    """Little-endian unsigned bytes as DECIMAL(20,0)."""
    return F.conv(F.hex(reverse_bytes(key)), 16, 10).cast("decimal(20,0)")


def composite(*parts: Column) -> Column:
    """Byte keys joined in order; end texts of varying length with ``b"\\0"`` (see :func:`text_part`)."""
    return F.concat(*parts)


def text_part(s: Column) -> Column:
    return F.concat(F.encode(s, "UTF-8"), F.lit(b"\0"))


def successor(prefix: bytes) -> bytes | None:
    """Smallest bytes above everything that starts with ``prefix``; None if all are 0xFF (or there are none)."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None


def separator(a: bytes, b: bytes) -> bytes:
    """Shortest bytes s with a < s <= b, for a < b."""
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return b[: same + 1]


def separator_of(a: Column, b: Column) -> Column:
    """:func:`separator` of BINARY columns."""
    differs = F.filter(F.sequence(F.lit(1), F.octet_length(b)), lambda i: ~F.substring(a, i, F.lit(1)).eqNullSafe(F.substring(b, i, F.lit(1))))
    return F.substring(b, F.lit(1), F.coalesce(F.array_min(differs), F.octet_length(b)))


def check_key(key: bytes, order: str, width: int | None = None) -> None:
    """Raise what a write of this key raises."""
    if not key or len(key) > MAX_KEY:
        raise StoreError(Code.KEY_TOO_LARGE if key else Code.INVALID_ARGUMENT, f"{len(key)} bytes")
    if order in WIDTH and len(key) != (width or WIDTH[order]):
        raise StoreError(Code.INVALID_ARGUMENT, f"an integer key has {WIDTH[order]} bytes, not {len(key)}")


def check_value(value: bytes) -> None:
    if len(value) > MAX_VALUE:
        raise StoreError(Code.VALUE_TOO_LARGE, f"{len(value)} bytes")
