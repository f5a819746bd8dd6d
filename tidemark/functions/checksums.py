"""Checksums of byte strings as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def _codes(text: Column) -> Column:
    """Code units of a string as UTF-16 has them."""
    data = F.encode(text, "UTF-16BE")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data), F.lit(1)), F.lit(2)), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(2))), 16, 10).cast("long"))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over UTF-16 code units, unit by unit, as each depends on the hash so far; meant for names."""
    start = F.lit(0x811C9DC5).cast("long")
    hashed = F.aggregate(_codes(text), start, lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(0x01000193).cast("long"), F.lit(1 << 32)))
    return F.when(F.length(text) == 0, start).otherwise(hashed)


def fletcher(data: Column) -> Column:
    """Two running sums modulo 65535, of bytes and of the first sum.

    In closed form, over arrays of bytes: the n bytes b_i add up to lo, and to hi with the weights n - i + 1.
    """

    def sums(column: pd.Series) -> pd.Series:
        def one(raw: bytes | None) -> int | None:
            if raw is None:
                return None
            codes = np.frombuffer(raw, np.uint8).astype(np.int64)
            weights = np.arange(len(codes), 0, -1) % 65535
            return int((codes * weights).sum() % 65535) << 16 | int(codes.sum() % 65535)

        return pd.Series([one(x) for x in column], dtype="Int64")

    return F.pandas_udf(sums, "long")(data.cast("binary"))
