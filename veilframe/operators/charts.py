"""Chart data as aggregates; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.privacy import k_anonymity
from veilframe.operators.profile import value_counts
from veilframe.operators.quantiles import exact_quantiles
from veilframe.schema import find_column, numeric_columns


def _stack(series: dict[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """(series, *cols) over all series."""
    parts = [df.select(F.lit(name).alias("series"), *[F.col(find_column(df, c)).alias(c) for c in cols]) for name, df in series.items()]
    return reduce(DataFrame.unionByName, parts)


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """1-based equal-width bin; the last bin includes the upper end."""
    if low == high:
        return F.lit(1).cast("bigint")
    return F.least(F.floor((x - F.lit(low)) * F.lit(bins) / F.lit(high - low)) + 1, F.lit(bins)).cast("bigint")


def histogram(series: dict[str, DataFrame], col: str, bins: int = 20) -> DataFrame:
    """(series, bin, bin_start, bin_end, count) over the range of all series together."""
    x = F.col(col).cast("double")
    stacked = _stack(series, [col]).select("series", x.alias("x")).dropna(subset=["x"])
    low, high = stacked.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return stacked.sparkSession.createDataFrame([], "series string, bin bigint, bin_start double, bin_end double, count bigint")
    width = (high - low) / bins
    counts = stacked.groupBy("series", _bin(F.col("x"), low, high, bins).alias("bin")).agg(F.count("*").alias("count"))
    start = F.lit(low) + (F.col("bin") - 1) * F.lit(width)
    return counts.select("series", "bin", start.alias("bin_start"), (start + F.lit(width)).alias("bin_end"), "count")


def density_histogram(
    series: dict[str, DataFrame], cols: Sequence[str] | None = None, bins: int = 30, max_columns: int | None = None
) -> DataFrame:
    """(series, column, bin, bin_start, bin_end, count, density): equal bins over each series' own range, area 1; empty bins too."""
    first, *others = series.values()
    if cols is None:
        cols = [c for c in numeric_columns(first) if all(find_column(o, c) in numeric_columns(o) for o in others)][:max_columns]
    schema = "series string, column string, bin bigint, bin_start double, bin_end double, count bigint, density double"
    parts = []
    for name, df in series.items():
        x = {c: F.col(find_column(df, c)).cast("double") for c in cols}
        ranges = df.agg(*[F.struct(F.min(e).alias("low"), F.max(e).alias("high"), F.count(e).alias("n")).alias(f"r{i}") for i, e in enumerate(x.values())]).first()
        cells, edges = [], []
        for i, (c, e) in enumerate(x.items()):
            low, high, n = ranges[f"r{i}"]
            if n:
                width = (high - low) / bins or 1.0 / bins
                cells.append(F.struct(F.lit(c).alias("column"), F.when(e.isNotNull(), _bin(e, low, high, bins)).alias("bin")))
                edges += [(c, b + 1, low + b * width, low + (b + 1) * width, n * width) for b in range(bins)]
        if not cells:
            continue
        counts = df.select(F.inline(F.array(*cells))).dropna(subset=["bin"]).groupBy("column", "bin").agg(F.count("*").alias("count"))
        drawn = df.sparkSession.createDataFrame(edges, "column string, bin bigint, bin_start double, bin_end double, scale double")
        filled = drawn.join(counts, ["column", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
        parts.append(filled.select(F.lit(name).alias("series"), "column", "bin", "bin_start", "bin_end", "count", (F.col("count") / F.col("scale")).alias("density")))
    return reduce(DataFrame.unionByName, parts) if parts else first.sparkSession.createDataFrame([], schema)


def category_counts(series: dict[str, DataFrame], col: str) -> DataFrame:
    """(series, value, count), nulls dropped."""
    parts = [
        value_counts(df, [find_column(df, col)], ordered=False).select(F.lit(name).alias("series"), "value", "count")
        for name, df in series.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("series", F.desc("count"), "value")


def box_stats(series: dict[str, DataFrame], col: str) -> DataFrame:
    """Quartiles, and whiskers at the outermost values within 1.5 interquartile ranges."""
    parts = []
    for name, df in series.items():
        c = find_column(df, col)
        found = exact_quantiles(df, [c], [0.25, 0.5, 0.75])[c]
        if found[0] is None:
            continue
        q1, q2, q3 = map(float, found)
        x = F.col(c).cast("double")
        reach = 1.5 * (q3 - q1)
        within = F.when((x >= F.lit(q1 - reach)) & (x <= F.lit(q3 + reach)), x)
        parts.append(
            df.agg(
                F.lit(name).alias("series"), F.count(x).alias("count"), F.min(x).alias("min"), F.min(within).alias("whisker_low"),
                F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
                F.max(within).alias("whisker_high"), F.max(x).alias("max"),
                (F.count(x) - F.count(within)).alias("outliers"),
            )
        )
    schema = (
        "series string, count bigint, min double, whisker_low double, q1 double, median double, q3 double, "
        "whisker_high double, max double, outliers bigint"
    )
    return reduce(DataFrame.unionByName, parts) if parts else next(iter(series.values())).sparkSession.createDataFrame([], schema)


def k_achieved_series(df: DataFrame, qi: Sequence[str], ks: Sequence[int] = (2, 5, 10, 20)) -> DataFrame:
    """(k, achieved) with achieved as 0 or 1."""
    return k_anonymity(df, qi, ks).select("k", F.col("achieved").cast("int").alias("achieved"))
