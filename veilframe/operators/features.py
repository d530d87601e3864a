"""Generalisation, scaling, encoding and feature vectors."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.dates import age_group, age_years, birth_month, birth_year, parse_date
from veilframe.operators.lookup import BROADCAST_BYTES, lookup_join
from veilframe.operators.ordered import with_row_index
from veilframe.operators.shape import long_values, rows, text_of
from veilframe.schema import Roles, find_column, present, require
from veilframe.session import materialise

MISSING_LEVEL = "nan"  # fixed value: the code table's name for a null
_SCALE_SCHEMA = "column string, min double, max double, mean double, std double"


def generalise_birthdate(df: DataFrame, as_of: dt.date | str, column: str = "BIRTHDATE") -> DataFrame:
    """age, birth_month, birth_year and age_group in place of the date; no-op without the column."""
    name = find_column(df, column)
    if name is None:
        return df
    born = parse_date(F.col(name))
    age = age_years(born, as_of)
    return df.withColumns(
        {"age": age, "birth_month": birth_month(born), "birth_year": birth_year(born), "age_group": age_group(age)}
    ).drop(name)


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, min, max, mean, std) with the population deviation, from one scan."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"l{i}"), F.max(x).alias(f"u{i}"), F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"l{i}").alias("min"), F.col(f"u{i}").alias("max"),
            F.col(f"a{i}").alias("mean"), F.col(f"s{i}").alias("std"),
        )
        for i, c in enumerate(cols)
    ]
    return rows(df.agg(*aggs), cells) if cols else df.sparkSession.createDataFrame([], _SCALE_SCHEMA)


def _scaled(c: str, p, method: str) -> Column:
    x = F.col(c).cast("double")
    if p["min"] is None or p["min"] == p["max"]:
        return F.when(x.isNotNull(), x - F.lit(p["min"] or 0.0))
    if method == "minmax":
        return (x - F.lit(p["min"])) / F.lit(p["max"] - p["min"])
    return (x - F.lit(p["mean"])) / F.lit(p["std"])


def apply_scaler(df: DataFrame, params: DataFrame, method: str = "minmax") -> DataFrame:
    """Scale with stored parameters; they are one row per column and become literals."""
    if method not in ("minmax", "standard"):
        raise ValueError("method must be 'minmax' or 'standard'")
    found = {p["column"]: p for p in params.collect()}
    return df.withColumns({c: _scaled(c, p, method) for c, p in found.items() if c in df.columns}) if found else df


def scale_minmax(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); 0 for a constant column."""
    return apply_scaler(df, fit_scaler(df, cols), "minmax")


def scale_standard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; 0 for a constant column."""
    return apply_scaler(df, fit_scaler(df, cols), "standard")


def fit_encoder(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, code): values as text in code-point order, numbered from 0 per column by a dense index."""
    texts = long_values(df, cols).select("column", F.coalesce("value", F.lit(MISSING_LEVEL)).alias("value"))
    levels = materialise(texts.distinct(), "levels")
    indexed = materialise(with_row_index(levels, ["column", "value"], "_index"), "indexed")
    starts = indexed.groupBy("column").agg(F.min("_index").alias("_start"))  # one row per column
    joined = indexed.join(F.broadcast(starts), "column")
    return joined.select("column", "value", (F.col("_index") - F.col("_start")).alias("code"))


def apply_encoder(df: DataFrame, codes: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Replace every encoded column by its codes; unseen values become null.

    Code tables are broadcast, smallest first, while the measured size of all of them together stays under
    ``broadcast_bytes``; all others are joined at once.
    """
    measured = codes.groupBy("column").agg(F.sum(F.octet_length("value") + 32).alias("bytes")).collect()
    sizes = {r["column"]: r["bytes"] for r in measured}  # one row per column
    order, held, large = df.columns, 0, []
    for c in sorted((c for c in order if c in sizes), key=lambda c: sizes[c]):
        held += sizes[c]
        if held > broadcast_bytes:
            large.append(c)
            continue
        table = codes.filter(F.col("column") == c).select(F.col("value").alias("_level"), F.col("code").alias("_code"))
        joined = df.withColumn("_level", _level_of(df, c)).join(F.broadcast(table), "_level", "left")
        df = joined.withColumn(c, F.col("_code")).select(*order)
    return _encode_cells(df, codes, large) if large else df


def _level_of(df: DataFrame, c: str) -> Column:
    return F.coalesce(text_of(df, c), F.lit(MISSING_LEVEL))


def _encode_cells(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Codes of large columns by one join, however many there are.

    The cells leave their rows as (row number, column and value), meet the code table in a join that spreads heavy cells, and come
    back to their rows by number; the other columns are shuffled once, for that.
    """
    placed = materialise(df.withColumn("_row", F.monotonically_increasing_id()), "placed")
    cell = lambda column, value: F.concat(column, F.lit("\0"), value)
    cells = [F.struct(F.lit(i).alias("_at"), cell(F.lit(c), _level_of(placed, c)).alias("_cell")) for i, c in enumerate(cols)]
    table = codes.filter(F.col("column").isin(list(cols))).select(cell(F.col("column"), F.col("value")).alias("_cell"), F.col("code").alias("_code"))
    found = lookup_join(placed.select("_row", F.inline(F.array(*cells))), table, "_cell")
    back = found.groupBy("_row").agg(*[F.max(F.when(F.col("_at") == i, F.col("_code"))).alias(f"_code{i}") for i in range(len(cols))])
    coded = {c: F.col(f"_code{i}").alias(c) for i, c in enumerate(cols)}
    return placed.join(back, "_row").select(*[coded.get(c, F.col(f"`{c}`")) for c in df.columns])


def encode_label(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cols = present(df, cols)
    return apply_encoder(df, materialise(fit_encoder(df, cols), "codes")) if cols else df


def _level_names(taken: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Names no later operator stumbles over: dots become underscores, and names equal but for case are numbered."""
    seen, out = {c.lower() for c in taken}, []
    for name in (w.replace(".", "_").replace("`", "_") for w in wanted):
        number, unique = 1, name
        while unique.lower() in seen:
            number += 1
            unique = f"{name}_{number}"
        seen.add(unique.lower())
        out.append(unique)
    return out


def encode_onehot(df: DataFrame, cols: Sequence[str], max_levels: int) -> DataFrame:
    """One 0/1 column ``{col}_{value}`` per value in sorted order; null gives all zeros.

    Levels become columns, so they have to fit a plan: the caller says how many a column may have, and more is an error.
    """
    cols = present(df, cols)
    if not cols:
        return df
    seen = long_values(df, cols).dropna(subset=["value"]).distinct().limit(max_levels * len(cols) + 1).collect()
    levels = {c: sorted(r["value"] for r in seen if r["column"] == c) for c in cols}
    wide = [c for c in cols if len(levels[c]) > max_levels]
    if wide or len(seen) > max_levels * len(cols):
        raise ValueError(f"more than {max_levels} levels in {', '.join(wide or cols)}")
    pairs = [(c, v) for c in cols for v in levels[c]]
    names = _level_names([c for c in df.columns if c not in cols], [f"{c}_{v}" for c, v in pairs])
    flags = [F.when(text_of(df, c) == F.lit(v), 1).otherwise(0).alias(name) for (c, v), name in zip(pairs, names)]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], *flags)


def encode(df: DataFrame, cols: Sequence[str], method: str = "label", max_levels: int | None = None) -> DataFrame:
    if method == "label":
        return encode_label(df, cols)
    if method == "onehot":
        if max_levels is None:
            raise ValueError("one-hot encoding needs max_levels")
        return encode_onehot(df, cols, max_levels)
    raise ValueError("method must be 'label' or 'onehot'")


def feature_names(df: DataFrame, roles: Roles) -> tuple[list[str], list[str]]:
    """(condition, target) columns that exist: critical + age_group, and quasi-identifiers + age."""
    return (
        present(df, [*roles.critical_features, "age_group"]),
        present(df, [*roles.quasi_identifiers, "age"]),
    )


def split_features(df: DataFrame, roles: Roles, key: str) -> DataFrame:
    """(row_key, condition, target) vectors; the feature names travel as column metadata."""
    (key,) = require(df, [key])
    condition, target = feature_names(df, roles)

    def vector(cols: Sequence[str], name: str) -> Column:
        values = F.array(*[F.col(c).cast("double") for c in cols]).cast("array<double>")
        return values.alias(name, metadata={"names": list(cols)})

    return df.select(F.col(key).alias("row_key"), vector(condition, "condition"), vector(target, "target"))
