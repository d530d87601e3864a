"""Utility metrics: how alike an original and an anonymised table are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.draws import uniform
from veilframe.operators.comoments import co_moments
from veilframe.operators.privacy import metric_rows
from veilframe.operators.profile import describe_numeric, dtype_counts, value_counts
from veilframe.operators.shape import null_count, rows
from veilframe.schema import find_column, numeric_columns

EPSILON = 1e-8
QUALITY_SCHEMA = "metric string, column string, key string, value double"


def holdout_split(df: DataFrame, key: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """``is_test`` per row, from the key alone: the split survives any repartitioning."""
    return df.withColumn("is_test", uniform(F.col(key), "holdout", seed) < F.lit(test))


def common_numeric(original: DataFrame, synthetic: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns numeric in both tables, in the original's order."""
    there = {c.lower() for c in numeric_columns(synthetic)}
    wanted = {c.lower() for c in cols} if cols is not None else None
    return [c for c in numeric_columns(original) if c.lower() in there and (wanted is None or c.lower() in wanted)]


def _moments(df: DataFrame, cols: Sequence[str], side: str, std=F.stddev_samp) -> DataFrame:
    """(column, mean_<side>, std_<side>) from one scan."""
    schema = f"column string, mean_{side} double, std_{side} double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    aggs, cells = [], []
    for i, c in enumerate(cols):
        x = F.col(find_column(df, c)).cast("double")
        aggs += [F.avg(x).alias(f"a{i}"), std(x).alias(f"s{i}")]
        cells.append(F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias(f"mean_{side}"), F.col(f"s{i}").alias(f"std_{side}")))
    return rows(df.agg(*aggs), cells)


def _relative(new: Column, old: Column) -> Column:
    return F.abs(new - old) / (F.abs(old) + F.lit(EPSILON))


def similarity(original: DataFrame, synthetic: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean and std of every common numeric column on both sides, and an ``overall`` row."""
    cols = common_numeric(original, synthetic, cols)
    both = _moments(original, cols, "original").join(_moments(synthetic, cols, "synthetic"), "column")
    scored = both.withColumns(
        {
            "mean_relative_diff": _relative(F.col("mean_synthetic"), F.col("mean_original")),
            "std_relative_diff": _relative(F.col("std_synthetic"), F.col("std_original")),
        }
    ).withColumn("similarity_score", F.lit(1.0) - (F.col("mean_relative_diff") + F.col("std_relative_diff")) / 2)
    per_column = scored.withColumn("columns_compared", F.lit(None).cast("bigint"))
    # Grouping by a constant keeps the overall row away where no column was compared.
    overall = scored.groupBy(F.lit("overall").alias("column")).agg(
        F.avg("similarity_score").alias("similarity_score"), F.count("*").alias("columns_compared")
    )
    return per_column.unionByName(overall, allowMissingColumns=True)


def matrix_fidelity(real: DataFrame, synthetic: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column mean and population std on both sides; an ``overall`` row with the mean absolute
    error of the cells of equal ``key`` and the mean absolute gap of the correlation matrices."""
    cols = [c for c in common_numeric(real, synthetic, cols) if c.lower() != key.lower()]
    if not cols:
        raise ValueError("no common numeric column")
    names = {c: f"_s{i}" for i, c in enumerate(cols)}
    other = synthetic.select(F.col(key), *[F.col(find_column(synthetic, c)).alias(s) for c, s in names.items()])
    gaps = real.select(key, *cols).join(other, key)
    totals = gaps.agg(
        *[F.sum(F.abs(F.col(c).cast("double") - F.col(s))).alias(f"e{i}") for i, (c, s) in enumerate(names.items())],
        *[F.count(F.col(c) - F.col(s)).alias(f"n{i}") for i, (c, s) in enumerate(names.items())],
    )

    def total(prefix: str) -> Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{prefix}{i}"), F.lit(0)) for i in range(len(cols))])

    errors = totals.select(F.lit("overall").alias("column"), F.try_divide(total("e"), total("n")).alias("mae"))
    states = co_moments([real, synthetic], cols)
    known = lambda x: None if np.isnan(x) else float(x)
    sides = [[(float(m) if n else None, known(d)) for n, m, d in zip(s.known, s.mean, s.deviation())] for s in states]
    gap = np.abs(states[0].correlations() - states[1].correlations())
    drift = float(gap[~np.isnan(gap)].mean()) if not np.isnan(gap).all() else None
    cells = [(c, *one, *two, None) for c, one, two in zip(cols, *sides)] + [("overall", None, None, None, None, drift)]
    schema = "column string, mean_real double, std_real double, mean_synthetic double, std_synthetic double, correlation_mae double"
    return real.sparkSession.createDataFrame(cells, schema).join(F.broadcast(errors), "column", "left")


def synthetic_quality(synthetic: DataFrame) -> DataFrame:
    """Shape, missing cells, type counts, numeric statistics and value counts as long rows."""
    missing = reduce(lambda a, b: a + b, [null_count(c) for c in synthetic.columns])
    n_cols = len(synthetic.columns)
    totals = synthetic.agg(F.count("*").alias("n"), missing.alias("m"))
    cells = F.col("n") * F.lit(n_cols)
    nothing = F.lit(None).cast("string")
    figures = {
        "rows": F.col("n").cast("double"),
        "columns": F.lit(float(n_cols)),
        "missing_values": F.col("m").cast("double"),
        "missing_percentage": F.try_divide(F.lit(100.0) * F.col("m"), cells),
    }
    shape = rows(
        totals,
        [F.struct(F.lit(k).alias("metric"), nothing.alias("column"), nothing.alias("key"), v.alias("value")) for k, v in figures.items()],
    )
    types = dtype_counts(synthetic).select(
        F.lit("data_types").alias("metric"), nothing.alias("column"), F.col("dtype").alias("key"), F.col("columns").cast("double").alias("value")
    )
    stats = describe_numeric(synthetic)
    numbers = stats.select(
        F.lit("numerical_stats").alias("metric"),
        "column",
        F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in stats.columns[1:]])),
    )
    parts = [shape, types, numbers]
    if any(t == "string" for _, t in synthetic.dtypes):
        counts = value_counts(synthetic, ordered=False)
        parts.append(
            counts.select(F.lit("categorical_stats").alias("metric"), "column", F.col("value").alias("key"), F.col("count").cast("double").alias("value"))
        )
    return reduce(DataFrame.unionByName, parts)


def compare_tables(original: DataFrame, synthetic: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Row and column ratios, common columns, and mean and std of the common numeric columns (of the first few if asked)."""
    common = [c for c in original.columns if find_column(synthetic, c) is not None]
    sides = original.agg(F.count("*").alias("o"), F.lit(None).cast("bigint").alias("s")).unionByName(
        synthetic.agg(F.lit(None).cast("bigint").alias("o"), F.count("*").alias("s"))
    )
    counts = sides.agg(F.max("o").alias("o"), F.max("s").alias("s"))
    width = len(original.columns)
    figures = {
        "row_ratio": F.try_divide(F.col("s"), F.col("o")),
        "column_ratio": F.lit(len(synthetic.columns) / width),
        "common_columns": F.lit(float(len(common))),
        "column_overlap": F.lit(len(common) / width),
    }
    nothing = F.lit(None).cast("string")
    shape = rows(counts, [F.struct(F.lit(k).alias("metric"), nothing.alias("column"), v.alias("value")) for k, v in figures.items()])
    cols = common_numeric(original, synthetic)[:max_columns]
    both = _moments(original, cols, "original").join(_moments(synthetic, cols, "synthetic"), "column")
    fields = ("mean_original", "mean_synthetic", "std_original", "std_synthetic")
    numbers = both.select(
        "column", F.inline(F.array(*[F.struct(F.lit(f).alias("metric"), F.col(f).alias("value")) for f in fields]))
    ).select("metric", "column", "value")
    return shape.unionByName(numbers)


def similarity_rows(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    """The similarity table as metric rows: fields that only the columns or only the overall row have appear there alone."""
    overall, counted = F.col("param") == "column=overall", F.col("field") == "columns_compared"
    scored = metric_rows(similarity(original, synthetic), "utility", "statistical_similarity", "column")
    return scored.filter((F.col("field") == "similarity_score") | (overall == counted))
