"""Scalar helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def round_up_half(c: Column, decimals: int = 0) -> Column:
    """Round at a decimal place, halves towards plus infinity; what isn't finite becomes 0."""
    s = 10.0**decimals
    return F.when(finite(c), F.floor(c * s + 0.5) / s).otherwise(0.0)


def significant(c: Column, digits: int = 7) -> Column:
    """Keep so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale)


def clamp01(c: Column) -> Column:
    return F.when(finite(c), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def non_negative(c: Column) -> Column:
    return F.when(finite(c) & (c > 0), c).otherwise(0.0)


def wrap32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def multiply32(a: Column, b: int) -> Column:
    """The low 32 bits of a product, in halves so that no long overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return wrap32(low * b + F.shiftleft(wrap32(high * b).bitwiseAND(F.lit(0xFFFF)), 16))


def cell_hash(index: Column, value: Column) -> Column:
    """A 32-bit hash of a voxel and its value to a quarter; 0 where that is 0."""
    q = wrap32(F.floor(value * 4 + 0.5).cast("long"))
    h = multiply32(wrap32(index.cast("long").bitwiseXOR(F.lit(0x9E3779B9))), 0x85EBCA6B)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13))
    h = multiply32(wrap32(h.bitwiseXOR(q)), 0xC2B2AE35)
    return F.when(q == 0, F.lit(0)).otherwise(h.bitwiseXOR(F.shiftrightunsigned(h, 16)))


def cell_hash_sql(index: str, value: str) -> str:
    """The same for DuckDB, whose HUGEINT holds the products."""
    q = f"((CAST(floor({value} * 4 + 0.5) AS BIGINT)) & 4294967295)"
    h1 = f"CAST((CAST(xor(CAST({index} AS BIGINT), 2654435769) & 4294967295 AS HUGEINT) * 2246822507) % 4294967296 AS BIGINT)"
    h2 = f"xor({h1}, {h1} >> 13)"
    h3 = f"CAST((CAST(xor({h2}, {q}) & 4294967295 AS HUGEINT) * 3266489909) % 4294967296 AS BIGINT)"
    return f"(CASE WHEN {q} = 0 THEN 0 ELSE xor({h3}, {h3} >> 16) END)"


def hex_signature(total: Column) -> Column:
    return F.concat(F.lit("bv1:"), F.lpad(F.lower(F.hex(total)), 8, "0"))


def valid_id(c: Column, most: int = 256) -> Column:
    """1 to `most` bytes after trimming, and no control characters."""
    return c.isNotNull() & F.octet_length(F.trim(c)).between(1, most) & ~c.rlike(r"[\x00-\x1f\x7f-\x9f]")


def is_index(c: Column) -> Column:
    return finite(c) & (c >= 0) & (c == F.floor(c)) & (c <= 9007199254740991)


def is_epoch(c: Column) -> Column:
    return finite(c) & c.between(0, 4_102_444_800)
