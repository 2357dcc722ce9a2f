"""Scalar helpers: money, key texts, enum order, decimals in bytes, JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def money(c: Column | str) -> Column:
    """Exact cents, so that sums don't depend on their order; -0.0 becomes 0."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(12,2)")


def revenue(price: Column, discount: Column) -> Column:
    return money(price) * (F.lit(1).cast("decimal(12,2)") - money(discount))


def key_text(*cols: Column | str) -> Column:
    """Trimmed values joined by ``|``."""
    return F.concat_ws("|", *(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")) for c in cols))


def enum_rank(c: Column, symbols: Sequence[str]) -> Column:
    """Position in the symbol list: the order of an enum."""
    return F.array_position(F.array(*(F.lit(s) for s in symbols)), c)


def decimal_from_bytes(c: Column, precision: int, scale: int) -> Column:
    """A big-endian two's complement number of any width as a decimal; null where it has over 38 digits."""
    wide = T.DecimalType(38, 0)
    byte = lambda i: F.conv(F.hex(F.substring(c, i, 1)), 16, 10).cast("int")
    signed = F.when(byte(F.lit(1)) >= 128, byte(F.lit(1)) - 256).otherwise(byte(F.lit(1))).cast(wide)
    add = lambda v, i: F.try_add(F.try_multiply(v, F.lit(256).cast(T.DecimalType(3, 0))), byte(i).cast(T.DecimalType(3, 0))).cast(wide)
    value = F.aggregate(F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: i > 1), signed, add)
    digits = F.lpad(F.abs(value).cast("string"), F.greatest(F.length(F.abs(value).cast("string")), F.lit(scale + 1)), F.lit("0"))
    whole = F.concat(F.when(value < 0, "-").otherwise(""), F.substr(digits, F.lit(1), F.length(digits) - scale), F.lit("."), F.right(digits, F.lit(scale)), F.lit("0"))
    return F.when(F.length(c) > 0, whole.try_cast(T.DecimalType(precision, scale)))


def hash128(*cols: Column | str) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(*cols).alias("hi"), F.xxhash64(F.lit(1), *cols).alias("lo"))


def partition_of(key: Column, degree: int) -> Column:
    """Partition number of an integer key."""
    return F.abs(key) % degree


def map_of(entries: Column) -> Column:
    """A map from an array of (key, value) structs."""
    return F.map_from_entries(entries)
