"""Column catalogue: statistics and anonymisation roles of the columns of many tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.shape import long_values, null_count, rows
from veilframe.schema import Roles

# Keyword lists of the two classifications; first match wins.
ANONYMISATION_RULES = (
    ("identifiers", ("id", "ssn", "drivers", "passport", "first", "last", "address")),
    ("quasi_identifiers", ("birthdate", "zip", "race", "ethnicity", "city", "state", "county")),
    ("critical_features", ("gender", "healthcare_expenses", "healthcare_coverage")),
    ("sensitive_attributes", ("lat", "lon", "maiden", "marital")),
)
CONTENT_RULES = (
    ("identifiers", ("id", "uuid", "code")),
    ("sensitive", ("name", "address", "phone", "email", "ssn", "birth")),
    ("clinical", ("diagnosis", "condition", "medication", "procedure", "test", "result")),
    ("demographic", ("age", "gender", "race", "ethnicity", "marital")),
)
Rules = Sequence[tuple[str, Sequence[str]]]


def role_of(name: Column, rules: Rules, match: str = "substring") -> Column:
    """First rule with a keyword in the name. ``match="token"`` asks for whole words, split at ``_``,
    so that MAIDEN no longer counts as an ``id``."""
    lowered = F.lower(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for role, words in rules:
        if match == "substring":
            hits = [lowered.contains(w) for w in words]
        elif match == "token":
            hits = [F.concat(F.lit("_"), lowered, F.lit("_")).contains(f"_{w}_") for w in words]
        else:
            raise ValueError("match must be 'substring' or 'token'")
        out = out.when(reduce(lambda a, b: a | b, hits), F.lit(role))
    return out


def kind_of(dtype: Column) -> Column:
    return (
        F.when(dtype.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), F.lit("numerical"))
        .when(dtype == "string", F.lit("categorical"))
        .when(dtype.rlike("^(date|timestamp)"), F.lit("datetime"))
    )


def column_catalogue(
    tables: dict[str, DataFrame],
    rules_a: Rules = ANONYMISATION_RULES,
    rules_b: Rules = CONTENT_RULES,
    match: str = "substring",
    distinct: str = "approx",
) -> DataFrame:
    """One row per (table, column): type, role under both rule sets, kind, null and distinct counts.

    ``distinct="approx"`` takes the distinct counts from sketches in the same scan; ``"exact"`` groups
    the values once more.
    """
    if distinct not in ("approx", "exact"):
        raise ValueError("distinct must be 'approx' or 'exact'")
    parts = []
    for table, df in tables.items():
        aggs = [null_count(c).alias(f"m{i}") for i, c in enumerate(df.columns)]
        if distinct == "approx":
            aggs += [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)]
        cells = [
            F.struct(
                F.lit(table).alias("table"),
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(t).alias("dtype"),
                F.col("n").alias("n_rows"),
                F.col(f"m{i}").alias("n_missing"),
                (F.col(f"d{i}") if distinct == "approx" else F.lit(None).cast("bigint")).alias("n_distinct"),
            )
            for i, (c, t) in enumerate(df.dtypes)
        ]
        part = rows(df.agg(F.count("*").alias("n"), *aggs), cells)
        if distinct == "exact":
            values = long_values(df, df.columns).dropna(subset=["value"])
            counts = values.groupBy("column", "value").count().groupBy("column").agg(F.count("*").alias("_d"))
            part = part.join(counts, "column", "left").withColumn("n_distinct", F.coalesce("_d", F.lit(0).cast("bigint")))
        parts.append(part)
    stats = reduce(DataFrame.unionByName, parts)
    return stats.select(
        "table", "position", "column", "dtype",
        role_of(F.col("column"), rules_a, match).alias("role"),
        role_of(F.col("column"), rules_b, match).alias("content"),
        kind_of(F.col("dtype")).alias("kind"),
        "n_rows", "n_missing", "n_distinct",
    )


def dtype_summary(catalogue: DataFrame) -> DataFrame:
    """Columns and known cells per table and type."""
    return catalogue.groupBy("table", "dtype").agg(
        F.count("*").alias("columns"), F.sum(F.col("n_rows") - F.col("n_missing")).alias("known_cells")
    )


def assign_roles(df: DataFrame, rules: Rules = ANONYMISATION_RULES, match: str = "substring") -> Roles:
    """The roles of one table's columns. Reads the schema only."""
    names = df.sparkSession.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)], "i int, c string, t string")
    found = names.select("c", role_of(F.col("c"), rules, match).alias("r"), kind_of(F.col("t")).alias("k")).orderBy("i").collect()

    def having(role: str) -> tuple[str, ...]:
        return tuple(row["c"] for row in found if row["r"] == role)

    return Roles(
        identifiers=having("identifiers"),
        quasi_identifiers=having("quasi_identifiers"),
        critical_features=having("critical_features"),
        sensitive_attributes=having("sensitive_attributes"),
        numerical_features=tuple(row["c"] for row in found if row["k"] == "numerical"),
        categorical_features=tuple(row["c"] for row in found if row["k"] == "categorical"),
    )
