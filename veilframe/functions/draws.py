"""Seeded random draws that depend on the row key alone, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13  # 52 bits: exact in a double, fine enough for cells of 10^12 rows
HASH_RANGE = float(16**_HEX_DIGITS)


def hash_bits(text: Column) -> Column:
    """The first 52 bits of the text's md5 as a bigint."""
    return F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def uniform(key: Column, purpose: str, seed: int) -> Column:
    """A double in [0, 1) from md5(key|purpose|seed)."""
    text = F.concat_ws("|", key.cast("string"), F.lit(purpose), F.lit(str(seed)))
    return hash_bits(text) / F.lit(HASH_RANGE)


def draw_int(key: Column, purpose: str, seed: int, low: int, high: int) -> Column:
    """An integer in [low, high)."""
    return (F.lit(low) + F.floor(uniform(key, purpose, seed) * F.lit(high - low))).cast("bigint")


def draw_rank(key: Column, purpose: str, seed: int, size: Column) -> Column:
    """A rank in 1..size."""
    return (F.lit(1) + F.floor(uniform(key, purpose, seed) * size)).cast("bigint")
