"""Sizes as people write them, in Python and as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Memory a shard's build is planned for: this many bytes for each byte of input.
BUILD_FACTOR = 64
DEFAULT_MEMORY, DEFAULT_MAX_QUERY = 512 << 20, 1 << 20
_UNITS = "BKMGTP"


def parse_size(text: str) -> int:
    """Bytes of ``10``, ``8K``, ``8M``, ``1g``. Zero, signs, fractions and anything over 64 bits are errors."""
    m = re.fullmatch(r"([0-9]+)([kKmMgG]?)", text.strip())
    n = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()] if m else 0
    if not 0 < n < 1 << 64:
        raise ValueError(f"invalid size {text!r}")
    return n


def format_bytes(n: int) -> str:
    """``1536`` as ``1.5K``; below 1024, plain bytes with a B."""
    if n < 1024:
        return f"{n}B"
    power = min((n.bit_length() - 1) // 10, 5)
    return f"{n / 1024**power:.1f}{_UNITS[power]}"


def shard_size_for_memory(limit: int) -> int:
    return limit // BUILD_FACTOR


def parse_size_col(text: Column) -> Column:
    """``parse_size`` of a column; null where it is an error (or more than a BIGINT holds)."""
    t = F.regexp_replace(text, r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    n = F.regexp_extract(t, r"^([0-9]+)[kKmMgG]?$", 1).try_cast("decimal(38,0)")
    unit = F.upper(F.regexp_extract(t, r"([kKmMgG])$", 1))
    factor = F.when(unit == "K", 1 << 10).when(unit == "M", 1 << 20).when(unit == "G", 1 << 30).otherwise(1).cast("decimal(12,0)")
    value = (n * factor).try_cast("bigint")
    return F.when(F.length(F.regexp_extract(t, r"^([0-9]+)[kKmMgG]?$", 1)) <= 19, F.when(value > 0, value))


def format_bytes_col(n: Column) -> Column:
    """``format_bytes`` of a column; halves go to the even digit, as the exact binary value does."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for power in range(1, 6):
        value = F.format_string("%.1f" + _UNITS[power], F.bround(n.cast("double") / F.lit(float(1024**power)), 1))
        out = F.when(n >= 1024**power, value).otherwise(out)
    return out
