"""Byte-exact predicates and projections as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOOM_BITS = 1 << 25
_A0, _FNV, _G, _C48 = 2237221, 435, 133837611498517, (1 << 48) - 1


def as_bytes(c: Column) -> Column:
    return c.cast("binary")


def found_in(content: Column, needle: Column, max_bytes: int = 0) -> Column:
    """Whether the needle's bytes are in the content: the one place of the guards.

    The empty needle is nowhere, nor is one of more than ``max_bytes`` (0: no limit), counted in bytes. A null content
    or needle gives false, never null.
    """
    needle = as_bytes(needle)
    hit = (F.octet_length(needle) > 0) & F.contains(as_bytes(content), needle)
    if max_bytes:
        hit = hit & (F.octet_length(needle) <= max_bytes)
    return F.coalesce(hit, F.lit(False))


def trim_line_end(line: Column) -> Column:
    """The bytes of a line without one line feed at its end, then without one carriage return."""
    line = as_bytes(line)

    def cut(c: Column, byte: str) -> Column:
        return F.when(F.endswith(c, F.unhex(F.lit(byte))), F.substring(c, F.lit(1), F.octet_length(c) - 1)).otherwise(c)

    return cut(cut(line, "0A"), "0D")


def positions(content: Column, n: int) -> Column:
    """1-based starts of the windows of ``n`` bytes; none where the content is shorter or null."""
    size = F.octet_length(as_bytes(content))
    return F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))


def windows(content: Column, n: int) -> Column:
    """All windows of ``n`` bytes, in order, as an array of binaries."""
    return F.transform(positions(content, n), lambda i: F.substring(as_bytes(content), i, F.lit(n)))


def gram_key(gram: Column) -> Column:
    """A gram of up to seven bytes as a big-endian number."""
    return F.conv(F.hex(gram), 16, 10).cast("bigint")


def bloom_bits(gram: Column) -> Column:
    """The two bits of a gram in a filter of 2^25 bits, as an array.

    The first is a 64-bit FNV-1a hash; the second adds a mixing hash made odd. Only the low 25 bits matter, so both are
    folded in BIGINTs that can't overflow.
    """
    hexed = F.hex(gram)
    codes = F.transform(F.sequence(F.lit(0), F.octet_length(gram) - 1), lambda i: F.conv(F.substring(hexed, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"))
    a = F.aggregate(codes, F.lit(_A0).cast("bigint"), lambda s, v: (s.bitwiseXOR(v) * _FNV).bitwiseAND(F.lit(BLOOM_BITS - 1)))
    c = F.aggregate(codes, F.lit(_G).cast("bigint"), lambda s, v: s.bitwiseXOR(v + _G + F.shiftleft(s, 6) + F.shiftright(s, 2)).bitwiseAND(F.lit(_C48)))
    return F.array(a, (a + c.bitwiseOR(F.lit(1).cast("bigint"))).bitwiseAND(F.lit(BLOOM_BITS - 1)))
