"""Helpers that turn aggregated rows and wide tables into long ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(one_row: DataFrame, structs: Sequence[Column], schema: str | None = None) -> DataFrame:
    """One output row per struct built from a single aggregated row."""
    if not structs:
        return one_row.sparkSession.createDataFrame([], schema)
    return one_row.select(F.inline(F.array(*structs)))


def null_count(c: str) -> Column:
    return F.count_if(F.col(f"`{c}`").isNull())


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing data here, so only NULL means missing from now on."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def text_of(df: DataFrame, c: str) -> Column:
    """The value as text; adding 0.0 folds -0.0 into 0.0 so equal numbers keep one spelling."""
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return (F.col(c) + F.lit(0.0)).cast("string")
    return F.col(c).cast("string")


def long_values(
    df: DataFrame,
    cols: Sequence[str],
    ids: Sequence[str] = (),
    name: str = "column",
    value: str = "value",
) -> DataFrame:
    """(ids..., name, value) with every listed column as text; nulls stay."""
    cells = [F.struct(F.lit(c).alias(name), text_of(df, c).alias(value)) for c in cols]
    return df.select(*ids, F.inline(F.array(*cells)))
