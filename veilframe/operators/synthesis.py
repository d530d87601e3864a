"""Conditional synthesis: draw target values from rows that share the condition cell.

A row's condition values (numbers in quantile bins) name its cell. Every target column is drawn on its
own from the rows of the cell, so a synthetic row keeps its condition values, follows the conditional
distribution of each target, and does not repeat one original tuple of quasi-identifiers. Cells with
too few rows fall back to the age group, then to the whole table.

Rows are told apart by a dense index in the order of the key and then of all columns used, so that null and
repeated keys keep their rows. Draws depend on that index and the seed only. Finding "the r-th row of the cell"
is an equi-join on (cell, rank), and ranks are numbered per hash slot of a cell, so no cell ever sits in one task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.draws import HASH_RANGE, draw_int, draw_rank, hash_bits, uniform
from veilframe.functions.masks import ADDRESS_REDACTED
from veilframe.operators.features import feature_names, generalise_birthdate
from veilframe.operators.lookup import HEAVY_LIMIT, HEAVY_ROWS, lookup_join
from veilframe.operators.ordered import with_row_index
from veilframe.operators.pseudonyms import redact
from veilframe.operators.quantiles import exact_quantiles
from veilframe.operators.roles import assign_roles
from veilframe.schema import PERSON_SCHEMA, find_column, numeric_columns, require
from veilframe.session import materialise

ROW = "_row"
BINS = 10
MIN_CELL = 20
NULL_TEXT = "?"


@dataclass(frozen=True)
class ConditionalModel:
    """``rows``: (row index, key, condition columns, cell, size). ``donors``: (cell, rank, target columns)."""

    key: str
    condition: tuple[str, ...]
    target: tuple[str, ...]
    rows: DataFrame
    donors: DataFrame


def _cell_text(df: DataFrame, c: str, edges: dict[str, list[float]]) -> Column:
    if c in edges:
        inner = [e for e in edges[c] if e is not None]
        above = [F.when(F.col(c) > F.lit(e), 1).otherwise(0) for e in inner]
        text = reduce(lambda a, b: a + b, above, F.lit(0)).cast("string")
        return F.when(F.col(c).isNull(), F.lit(NULL_TEXT)).otherwise(text)
    return F.coalesce(F.col(c).cast("string"), F.lit(NULL_TEXT))


def _routes(sizes: DataFrame, min_cell: int) -> DataFrame:
    """Per finest cell: the cell to draw from, its size, and whether its rows also donate to the
    coarser cells. Works on the stored cell counts only."""
    middle = sizes.groupBy("_c1").agg(F.sum("_n0").alias("_n1"))
    whole = sizes.groupBy("_c2").agg(F.sum("_n0").alias("_n2"))
    routed = sizes.join(middle, "_c1").join(F.broadcast(whole), "_c2")  # one row
    level = F.when(F.col("_n0") >= min_cell, 0).when(F.col("_n1") >= min_cell, 1).otherwise(2)
    routed = routed.withColumn("_level", level)
    gives = [routed.groupBy(f"_c{i}").agg(F.max((F.col("_level") == i).cast("int")).alias(f"_gives{i}")) for i in (1, 2)]
    return (
        routed.join(gives[0], "_c1").join(F.broadcast(gives[1]), "_c2")
        .select(
            "_c0",
            F.when(F.col("_level") == 0, F.col("_c0")).when(F.col("_level") == 1, F.col("_c1")).otherwise(F.col("_c2")).alias("cell"),
            F.when(F.col("_level") == 0, F.col("_n0")).when(F.col("_level") == 1, F.col("_n1")).otherwise(F.col("_n2")).alias("size"),
            (F.col("_level") == 0).alias("_gives0"),
            (F.col("_gives1") == 1).alias("_gives1"),
            (F.col("_gives2") == 1).alias("_gives2"),
        )
    )


def ranked(df: DataFrame, cell: str, key: str, slots: int) -> DataFrame:
    """1-based ``rank`` within ``cell`` in the order of the key's hash.

    Slots are ranges of that hash: rank inside the slot plus the rows of the slots before it. The
    result does not depend on the number of slots.
    """
    digest = hash_bits(F.col(key).cast("string"))
    slot = F.floor(digest / F.lit(HASH_RANGE) * slots)
    placed = df.withColumns({"_digest": digest, "_slot": slot.cast("bigint")})
    before = Window.partitionBy(cell).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(cell, "_slot").agg(F.count("*").alias("_rows"))
    offsets = sizes.select(cell, "_slot", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(cell, "_slot").orderBy("_digest", key)
    numbered = placed.withColumn("_place", F.row_number().over(inside)).join(offsets, [cell, "_slot"])
    return numbered.withColumn("rank", F.col("_offset") + F.col("_place")).drop("_digest", "_slot", "_place", "_offset")


def fit_conditional(
    df: DataFrame,
    key: str,
    condition: Sequence[str],
    target: Sequence[str],
    bins: int = BINS,
    min_cell: int = MIN_CELL,
    backoff: str = "age_group",
    slots: int | None = None,
    store: bool = True,
) -> ConditionalModel:
    """Learn p(target | condition). ``key`` names rows in the result; it may be null or repeat.

    ``store=False`` leaves the donor table unwritten, for a model that is sampled once.
    """
    (key,) = require(df, [key])
    condition, target = require(df, condition), require(df, target)
    if not target:
        raise ValueError("nothing to draw")
    slots = slots or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbers = [c for c in condition if c in numeric_columns(df)]
    edges = exact_quantiles(df, numbers, [i / bins for i in range(1, bins)])
    middle = [c for c in condition if c.lower() == backoff]

    def cell(level: int, cols: Sequence[str]) -> Column:
        return F.concat_ws("|", F.lit(str(level)), *[_cell_text(df, c, edges) for c in cols])

    base = df.select(key, *condition, *[c for c in target if c not in condition])
    base = with_row_index(base, base.columns, ROW)
    cells = base.withColumns({"_c0": cell(0, condition), "_c1": cell(1, middle), "_c2": cell(2, [])})
    sizes = materialise(cells.groupBy("_c0", "_c1", "_c2").agg(F.count("*").alias("_n0")), "cells")
    routes = materialise(_routes(sizes, min_cell), "routes")
    top = sizes.filter(F.col("_n0") >= HEAVY_ROWS).orderBy(F.desc("_n0")).limit(HEAVY_LIMIT)
    routed = lookup_join(cells, routes, "_c0", heavy=[r["_c0"] for r in top.collect()])
    gives = F.filter(
        F.array(*[F.when(F.col(f"_gives{i}"), F.col(f"_c{i}")) for i in range(3)]), lambda c: c.isNotNull()
    )
    stored = materialise(routed.select(*base.columns, "cell", "size", gives.alias("_cells")), "routed")
    donors = stored.select(ROW, *target, F.explode("_cells").alias("_cell"))
    donors = ranked(donors, "_cell", ROW, slots).select(F.col("_cell").alias("cell"), "rank", *target)
    return ConditionalModel(
        key,
        tuple(condition),
        tuple(target),
        stored.select(ROW, key, *condition, "cell", "size"),
        materialise(donors, "donors") if store else donors,
    )


def _resampled(model: ConditionalModel, n: int, seed: int) -> DataFrame:
    """``n`` condition rows drawn with replacement; the draw number becomes row index and key."""
    spark = model.rows.sparkSession
    total = model.rows.count()
    if not total:
        return model.rows
    draws = spark.range(n).select(F.col("id").alias("_draw"), F.floor(uniform(F.col("id"), "row", seed) * F.lit(total)).alias(ROW))
    return draws.join(model.rows.drop(model.key), ROW).withColumn(ROW, F.col("_draw")).withColumnRenamed("_draw", model.key)


def sample_conditional(model: ConditionalModel, n: int | None = None, seed: int = 42) -> DataFrame:
    """(key, targets, conditions), one row per condition row, or ``n`` rows in all."""
    return _sampled(model, n, seed).drop(ROW)


def _sampled(model: ConditionalModel, n: int | None, seed: int) -> DataFrame:
    rows = model.rows if n is None else materialise(_resampled(model, n, seed), "resampled")
    asks = [
        F.struct(F.lit(i).alias("_column"), draw_rank(F.col(ROW), c, seed, F.col("size")).alias("rank"))
        for i, c in enumerate(model.target)
    ]
    requests = rows.select(ROW, "cell", F.inline(F.array(*asks)))
    # A rank is at most the size of its cell, and every rank has a donor.
    answered = requests.join(model.donors, ["cell", "rank"], "left")
    picks = [F.max(F.when(F.col("_column") == i, F.col(c))).alias(c) for i, c in enumerate(model.target)]
    targets = answered.groupBy(ROW).agg(*picks)
    conditions = rows.select(ROW, model.key, *[c for c in model.condition if c not in model.target])
    kept = [c for c in conditions.columns if c not in (ROW, model.key)]
    return assemble_synthetic(targets, conditions, ROW).select(ROW, model.key, *model.target, *kept)


def assemble_synthetic(targets: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """Drawn targets next to the preserved conditions of the same row; ``key`` is unique, and may be null once."""
    others = conditions.withColumnRenamed(key, "_other")
    return targets.join(others, F.col(key).eqNullSafe(F.col("_other"))).drop("_other")


def synthetic_identities(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Made-up identifiers numbered by a dense index in the order of the key, then of the other columns; replaces ``key``."""
    return _identified(with_row_index(df, [key, *[c for c in df.columns if c != key]], ROW).drop(key), seed)


def _identified(indexed: DataFrame, seed: int) -> DataFrame:
    row = F.col(ROW)
    ssn = F.concat_ws(
        "-",
        draw_int(row, "ssn-area", seed, 100, 999).cast("string"),
        draw_int(row, "ssn-group", seed, 10, 99).cast("string"),
        draw_int(row, "ssn-serial", seed, 1000, 9999).cast("string"),
    )
    named = indexed.withColumns(
        {
            "Id": F.format_string("synth_%06d", row),
            "SSN": ssn,
            "FIRST": F.format_string("Synthetic_First_%03d", row),
            "LAST": F.format_string("Synthetic_Last_%03d", row),
            "ADDRESS": F.lit(ADDRESS_REDACTED),
        }
    )
    return redact(named.drop(ROW))


def conform(df: DataFrame, schema: T.StructType = PERSON_SCHEMA) -> DataFrame:
    """The schema's columns in its order; absent ones as nulls, surplus ones dropped."""
    out = []
    for field in schema.fields:
        found = find_column(df, field.name)
        value = F.col(found) if found else F.lit(None).cast(field.dataType)
        out.append(value.alias(field.name))
    return df.select(*out)


def synthesise(
    df: DataFrame,
    as_of: dt.date | str,
    key: str = "Id",
    n: int | None = None,
    seed: int = 42,
    bins: int = BINS,
    min_cell: int = MIN_CELL,
) -> DataFrame:
    """A synthetic person table in the canonical layout from a raw person table: a row for each row, whatever its key."""
    (key,) = require(df, [key])
    aged = generalise_birthdate(df, as_of)
    condition, target = feature_names(aged, assign_roles(aged))
    model = fit_conditional(aged, key, condition, target, bins=bins, min_cell=min_cell, store=False)
    return conform(_identified(_sampled(model, n, seed).drop(key), seed))
