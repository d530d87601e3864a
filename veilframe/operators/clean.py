"""Duplicate removal and imputation."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.masks import UNKNOWN
from veilframe.operators.quantiles import exact_quantiles
from veilframe.operators.shape import rows
from veilframe.schema import numeric_columns, string_columns
from veilframe.session import materialise


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def _present_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, dict[str, int]]:
    row = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row["n"], {c: row[f"c{i}"] for i, c in enumerate(cols)}


def _fill_medians(df: DataFrame, cols: Sequence[str], counts: dict[str, int]) -> DataFrame:
    medians = {c: q[0] for c, q in exact_quantiles(df, cols, [0.5], counts=counts).items() if q[0] is not None}
    out = {}
    for c, m in medians.items():
        dtype = df.schema[c].dataType.simpleString()
        # An integer column becomes a double where its median needs one.
        keep = dtype if isinstance(m, (int, Decimal)) or dtype in ("double", "float") else "double"
        out[c] = F.coalesce(F.col(c).cast(keep), F.lit(m).cast(keep))
    return df.withColumns(out) if out else df


def impute_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Numeric nulls become the column median; a column without any value is left alone."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return _fill_medians(df, cols, _present_counts(df, cols)[1]) if cols else df


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, mode): most frequent value, the smallest on ties. Grouped by value first, so that a
    column of distinct values is spread over the cluster."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols]
    counts = df.select(F.inline(F.array(*cells))).dropna(subset=["value"]).groupBy("column", "value").count()
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))


def impute_mode(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """String nulls become the column mode, or 'Unknown' if there is no value at all."""
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return df
    modes = {r["column"]: r["mode"] for r in column_modes(df, cols).collect()}  # one row per column
    return df.fillna({c: modes.get(c, UNKNOWN) for c in cols})


def drop_sparse_columns(df: DataFrame, pct: float = 50.0) -> DataFrame:
    """Drop columns with strictly more than ``pct`` percent nulls."""
    n, counts = _present_counts(df, df.columns)
    return df.drop(*[c for c in df.columns if n and 100.0 * (n - counts[c]) / n > pct])


def drop_sparse_rows(df: DataFrame, frac: float = 0.8) -> DataFrame:
    """Drop rows with strictly more than ``frac`` of their cells null."""
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns])
    return df.filter(nulls <= F.lit(frac * len(df.columns)))


def fill_constant(df: DataFrame, value: float = 0) -> DataFrame:
    return df.fillna(value)


def clean(df: DataFrame) -> DataFrame:
    """Duplicates, medians, modes, sparse columns, sparse rows, in this order.

    The deduplicated table is written once; the statistics after it read single columns of it.
    """
    unique = materialise(drop_duplicate_rows(df), "unique")
    n, counts = _present_counts(unique, unique.columns)
    gaps = [c for c in unique.columns if counts[c] < n]
    numbers = [c for c in numeric_columns(unique) if c in gaps]
    texts = [c for c in string_columns(unique) if c in gaps]
    filled = impute_mode(_fill_medians(unique, numbers, counts), texts) if gaps else unique
    # Imputation leaves nulls only where a number column is empty or the type is neither.
    sparse = [
        c
        for c in gaps
        if c not in texts and (c not in numbers or not counts[c]) and 100.0 * (n - counts[c]) / n > 50.0
    ]
    return drop_sparse_rows(filled.drop(*sparse))


def clean_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row and column counts of a table before and after cleaning."""
    parts = [
        df.agg(F.lit(stage).alias("stage"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"))
        for stage, df in (("before", before), ("after", after))
    ]
    return parts[0].unionByName(parts[1])
