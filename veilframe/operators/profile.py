"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.quantiles import exact_quantiles
from veilframe.operators.shape import long_values, null_count, rows
from veilframe.schema import numeric_columns, string_columns


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows, from one grouping.

    Rows are grouped by two 64-bit hashes of their cells, so that no full row is shuffled. Hashes skip nulls, so where the
    nulls are is hashed as well.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    blank = [c.isNull() for c in cols]
    cells = reduce(lambda a, b: a + b, [b.cast("int") for b in blank])
    keys = [F.xxhash64(*cols, *blank).alias("_h1"), F.xxhash64(F.lit(1), *reversed(cols), *blank).alias("_h2")]
    distinct = df.select(*keys, cells.alias("_missing")).groupBy("_h1", "_h2").agg(F.count("*").alias("_copies"), F.sum("_missing").alias("_missing"))
    return distinct.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_records"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum("_missing"), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_records"),
    )


COLUMNS_PER_SCAN = 100  # a plan's cost grows faster than its number of aggregates


def _batches(cols: Sequence[str]) -> list[list[str]]:
    return [list(cols[i : i + COLUMNS_PER_SCAN]) for i in range(0, len(cols), COLUMNS_PER_SCAN)]


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with any null: count and percentage of rows."""
    return reduce(DataFrame.unionByName, [_missing(df.select(*[F.col(f"`{c}`") for c in part])) for part in _batches(df.columns)])


def _missing(df: DataFrame) -> DataFrame:
    totals = df.agg(F.count("*").alias("_rows"), *[null_count(c).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"_m{i}").alias("missing_count"),
            F.try_divide(F.lit(100.0) * F.col(f"_m{i}"), F.col("_rows")).alias("missing_pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    return rows(totals, cells).filter("missing_count > 0")


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns per type, read from the schema."""
    types = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string")
    return types.groupBy("dtype").agg(F.count("*").alias("columns"))


def dataset_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: shape, column list, missing cells."""
    parts = []
    for name, df in tables.items():
        missing = reduce(lambda a, b: a + b, [null_count(c) for c in df.columns])
        parts.append(
            df.agg(
                F.lit(name).alias("table"),
                F.count("*").alias("n_rows"),
                F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
                F.lit(",".join(df.columns)).alias("columns"),
                missing.alias("missing_values"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column.

    ``approximate`` takes the quartiles from ``percentile_approx`` in the same scan.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    if len(cols) > COLUMNS_PER_SCAN:
        return reduce(DataFrame.unionByName, [describe_numeric(df, part, approximate) for part in _batches(cols)])
    schema = "column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"l{i}"), F.max(x).alias(f"u{i}"),
        ]
        if approximate:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    exact = {} if approximate else exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    cells = []
    for i, c in enumerate(cols):
        q = [F.col(f"q{i}")[j] if approximate else F.lit(exact[c][j]).cast("double") for j in range(3)]
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
                F.col(f"s{i}").alias("std"), F.col(f"l{i}").alias("min"), q[0].alias("p25"),
                q[1].alias("p50"), q[2].alias("p75"), F.col(f"u{i}").alias("max"),
            )
        )
    return rows(df.agg(*aggs), cells)


def value_counts(df: DataFrame, cols: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
    """(column, value, count) of the non-null values, most frequent first within a column."""
    cols = list(cols) if cols is not None else string_columns(df)
    counts = long_values(df, cols).dropna(subset=["value"]).groupBy("column", "value").agg(F.count("*").alias("count"))
    return counts.orderBy("column", F.desc("count"), "value") if ordered else counts
