"""Joins and per-key totals that stay balanced when one key holds much of the table.

Heavy keys are few by definition, so their lookup rows fit a broadcast. The rows of heavy keys still pass
through the shuffle join for all other keys, but under a salt of their own: they spread over the
partitions and match nothing there. The salt comes from the input partition and the row's own values, so
a recomputed task puts every row where it was, and exact copies spread as far as their partitions do.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_ROWS = 1_000_000
HEAVY_LIMIT = 1_000  # keys treated as heavy; after them no key holds more than rows / 1001
BROADCAST_BYTES = 64 << 20
_SALTS = 1 << 16


def spread_join(
    rows: DataFrame, table: DataFrame, heavy: DataFrame, on: Sequence[str], names: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    """``rows`` plus the ``names`` columns of ``table``; ``heavy`` is at most ``HEAVY_LIMIT`` of its rows."""
    few = heavy.select(*on, *[F.col(n).alias(f"_heavy_{n}") for n in names], F.lit(True).alias("_hit"))
    loose = F.col("_hit").isNotNull()
    for c in on:
        loose = loose | F.col(c).isNull()
    salt = F.when(loose, F.pmod(F.xxhash64(F.spark_partition_id(), *spread), F.lit(_SALTS)) + 1).otherwise(F.lit(0))
    salted = rows.join(F.broadcast(few), list(on), "left").withColumn("_salt", salt.cast("bigint"))
    # Zero, but no constant: a constant the optimiser would put in place of the salt, and the shuffle would go by the keys alone.
    rest = table.select(*on, *names, F.pmod(F.xxhash64(*on), F.lit(1)).alias("_salt"))
    joined = salted.join(rest, [*on, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_heavy_{n}", n).alias(n) for n in names])


def heavy_keys(df: DataFrame, key: str, min_rows: int = HEAVY_ROWS) -> tuple[list, bool]:
    """Keys with at least ``min_rows`` rows and 0.1 % of the table, and whether any key is null.

    One scan with a bounded sketch. The list only steers the join, so an over- or under-estimated count
    costs time, never rows.
    """
    sketch = df.agg(
        F.count("*").alias("rows"),
        F.count(key).alias("keyed"),
        F.expr(f"approx_top_k(`{key}`, {HEAVY_LIMIT}, {10 * HEAVY_LIMIT})").alias("top"),
    ).first()
    least = max(min_rows, sketch["keyed"] // 1_000)
    heavy = [r["item"] for r in sketch["top"] or [] if r["item"] is not None and r["count"] >= least]
    return heavy, sketch["rows"] - sketch["keyed"] >= min_rows


def lookup_join(
    df: DataFrame, table: DataFrame, key: str, min_rows: int = HEAVY_ROWS, heavy: list | None = None
) -> DataFrame:
    """Left join to ``table`` (unique on ``key``).

    Without heavy or many null keys it is an ordinary join, which Spark may turn into a broadcast once it
    knows the size. A caller that has counted its (never null) keys passes the heavy ones and saves a scan.
    """
    heavy, many_nulls = heavy_keys(df, key, min_rows) if heavy is None else (heavy, False)
    if not heavy and not many_nulls:
        return df.join(table, key, "left")
    names = [c for c in table.columns if c != key]
    few = table.filter(F.col(key).isin(heavy) if heavy else F.lit(False))
    return spread_join(df, table, few, [key], names, spread=df.columns)


def attach_totals(
    rows: DataFrame, source: DataFrame, on: Sequence[str], totals: dict[str, Column], spread: Sequence[str]
) -> DataFrame:
    """``rows`` plus aggregates of the ``source`` rows that share ``on``."""
    per_key = source.groupBy(*on).agg(
        *[expr.alias(name) for name, expr in totals.items()], F.count("*").alias("_members")
    )
    # Both uses keep the same columns and filters, so that they share one exchange.
    keyed = per_key.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on]) & (F.col("_members") > 0))
    heavy = keyed.orderBy(F.desc("_members"), *on).limit(HEAVY_LIMIT)
    return spread_join(rows, keyed, heavy, on, list(totals), spread)
