"""XXH3-64 digests as an Arrow UDF; unsigned, so DECIMAL(20,0)."""

from __future__ import annotations

from decimal import Decimal

import pandas as pd
import xxhash
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DecimalType


@pandas_udf(DecimalType(20, 0))
def xxh3_64(data: pd.Series) -> pd.Series:
    """Digest of BINARY or STRING values; null for null."""
    return pd.Series([None if x is None else Decimal(xxhash.xxh3_64_intdigest(x)) for x in data])


def xxh3_hex(data: bytes) -> str:
    return xxhash.xxh3_64_hexdigest(data)


def streamed(parts) -> int:
    """Digest of a sequence of byte strings taken as one."""
    h = xxhash.xxh3_64()
    for p in parts:
        h.update(p)
    return h.intdigest()
