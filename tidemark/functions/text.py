"""Small helpers for display and for archive headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def is_printable(data: bytes) -> bool:
    """Whether at least three quarters of the bytes are printable ASCII."""
    return not data or sum(32 <= b < 127 for b in data) * 4 >= 3 * len(data)


def show(data: bytes, mode: str = "auto") -> str:
    """Bytes as hex or as escaped text; ``auto`` takes text if the bytes are mostly printable."""
    if mode == "hex" or mode == "auto" and not is_printable(data):
        return data.hex()
    return "".join(chr(b) if 32 <= b < 127 and b != 92 else f"\\x{b:02x}" for b in data)


def printable_share(data: Column) -> Column:
    """Share of printable ASCII bytes of a BINARY column (1 for none)."""
    text = F.decode(data, "ISO-8859-1")
    return F.when(F.octet_length(data) == 0, 1.0).otherwise(F.length(F.regexp_replace(text, r"[^\x20-\x7e]", "")) / F.octet_length(data))


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024 or unit == "TiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024


@pandas_udf(StringType())
def human(n: pd.Series) -> pd.Series:
    """:func:`human_bytes` of a column."""
    return n.map(human_bytes, na_action="ignore")


def octal(n: Column, width: int = 11) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 8), width, "0")


def from_octal(s: Column) -> Column:
    return F.conv(F.trim(s), 8, 10).cast("long")


def nanos_of(ts: Column) -> Column:
    """TIMESTAMP to nanoseconds since 1970."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def micros_of(nanos: Column) -> Column:
    return (nanos / 1000).cast("long")
