"""End-to-end workflows; each returns DataFrames and leaves writing to its last step."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.clean import clean
from veilframe.operators.features import apply_encoder, apply_scaler, fit_encoder, fit_scaler, generalise_birthdate, split_features
from veilframe.operators.models import MODELS, model_utility
from veilframe.operators.ordered import fill_directional
from veilframe.operators.privacy import metric_rows, privacy_report
from veilframe.operators.profile import profile_table
from veilframe.operators.pseudonyms import pseudonymise_table
from veilframe.operators.roles import assign_roles, column_catalogue
from veilframe.operators.synthesis import synthesise
from veilframe.operators.utility import compare_tables, similarity_rows, synthetic_quality
from veilframe.schema import QUASI_IDENTIFIERS, SENSITIVE, Roles, find_column, present, require
from veilframe.session import materialise, run_scope
from veilframe.sources.report import read_report, write_report
from veilframe.sources.store import save_params, write_features
from veilframe.sources.tables import read_people, write_table


def preprocess(
    spark: SparkSession,
    path: str,
    output: str | None = None,
    n_records: int | None = None,
    order_by: Sequence[str] = (),
    **reader,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read, profile, classify and clean: (cleaned table, profile, column catalogue)."""
    people = materialise(read_people(spark, path, n_records, order_by, **reader), "people")
    cleaned = clean(people)
    if output:
        write_table(cleaned, output)
        cleaned = spark.read.schema(cleaned.schema).parquet(output)
    return cleaned, profile_table(people), column_catalogue({"input": people})


@dataclass(frozen=True)
class Prepared:
    """The processed table, its (row_key, condition, target) vectors, and the fitted parameters."""

    table: DataFrame
    features: DataFrame
    scaler: DataFrame
    codes: DataFrame
    roles: Roles


def prepare_features(df: DataFrame, as_of: dt.date | str, key: str = "Id", order_by: Sequence[str] = ()) -> Prepared:
    """Ages for birth dates, directional fill, min-max scaling, label codes, feature vectors.

    Roles are taken after the ages were derived, so that age is scaled and age_group encoded. The key is
    neither encoded nor scaled: it is what joins vectors and table later.
    """
    (key,) = require(df, [key])
    aged = generalise_birthdate(df, as_of)
    roles = assign_roles(aged)
    filled = materialise(fill_directional(aged, list(order_by) or [key]), "filled")
    numbers = [c for c in roles.numerical_features if c != key]
    texts = [c for c in roles.categorical_features if c != key]
    scaler = fit_scaler(filled, numbers)
    codes = materialise(fit_encoder(filled, texts), "codes")
    table = apply_encoder(apply_scaler(filled, scaler), codes)
    return Prepared(table, split_features(table, roles, key), scaler, codes, roles)


def validate(
    original: DataFrame,
    anonymised: DataFrame,
    key: str | None = None,
    models: Sequence[str] = MODELS,
    qi: Sequence[str] = QUASI_IDENTIFIERS,
    sensitive: Sequence[str] = SENSITIVE,
    **model_options,
) -> DataFrame:
    """Privacy of the anonymised table and its utility against the original, as metric rows."""
    qi, sensitive = present(anonymised, qi), present(anonymised, sensitive)
    parts = [privacy_report(anonymised, qi, sensitive), similarity_rows(original, anonymised)]
    if models:
        key = key or find_column(original, "Id")
        scores = model_utility(original, anonymised, key, models=models, **model_options)
        parts.append(metric_rows(scores, "utility", "ml_performance", "model"))
    sides = [
        df.agg(F.lit(name).alias("side"), F.count("*").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"))
        for name, df in (("original", original), ("anonymised", anonymised))
    ]
    parts.append(metric_rows(sides[0].unionByName(sides[1]), "dataset_info", "shape", "side"))
    names = original.sparkSession.createDataFrame(
        [(",".join(qi), ",".join(sensitive))], "quasi_identifiers string, sensitive_attributes string"
    )
    parts.append(metric_rows(names, "dataset_info", "columns"))
    return reduce(DataFrame.unionByName, parts)


def _report_part(metrics: DataFrame, dataset: str) -> DataFrame:
    return metrics.select(F.lit(dataset).alias("dataset"), "*")


def _quality_rows(original: DataFrame, synthetic: DataFrame) -> DataFrame:
    both = synthetic_quality(synthetic).unionByName(compare_tables(original, synthetic), allowMissingColumns=True)
    return both.select(
        F.lit("utility").alias("family"),
        F.lit("synthetic_quality").alias("metric"),
        F.concat_ws(".", "column", "key").alias("param"),
        F.col("metric").alias("field"),
        F.col("value").alias("value_num"),
        F.lit(None).cast("string").alias("value_str"),
    )


def anonymise(
    df: DataFrame,
    as_of: dt.date | str,
    mapping_path: str | None = None,
    mode: str = "random",
    secret: str = "",
    n_synthetic: int | None = None,
    synthesis: bool = True,
    models: Sequence[str] = MODELS,
    seed: int = 42,
    **model_options,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Pseudonymised and synthetic tables of a raw person table, and the report on both.

    Pseudonyms are made from the raw values; ages replace birth dates before anything is published.
    """
    aged = generalise_birthdate(df, as_of)
    tables = {"pseudonymised": materialise(pseudonymise_table(aged, mapping_path, mode, secret), "pseudonymised")}
    if synthesis:
        tables["synthetic"] = materialise(synthesise(df, as_of, n=n_synthetic, seed=seed), "synthetic")
    parts = [_report_part(metric_rows(profile_table(df), "profile", "structure"), "original")]
    for name, table in tables.items():
        # Columns that only the canonical layout added hold nothing to identify anyone by.
        qi = [c for c in QUASI_IDENTIFIERS if find_column(aged, c)]
        parts.append(_report_part(validate(aged, table, qi=qi, models=models, **model_options), name))
    if synthesis:
        parts.append(_report_part(_quality_rows(df, tables["synthetic"]), "synthetic"))
    return tables, reduce(DataFrame.unionByName, parts)


def anonymise_no_synthesis(df: DataFrame, as_of: dt.date | str, **options) -> tuple[dict[str, DataFrame], DataFrame]:
    return anonymise(df, as_of, synthesis=False, **options)


def anonymise_files(
    spark: SparkSession,
    path: str,
    output: str,
    as_of: dt.date | str,
    n_records: int | None = None,
    order_by: Sequence[str] = (),
    synthesis: bool = True,
    mode: str = "random",
    reader: dict | None = None,
    **options,
) -> DataFrame:
    """The whole run on files; returns the report.

    Below ``output``: ``catalogue``, ``processed``, ``features``, ``scaler``, ``codes``, ``mapping``,
    ``pseudonymised``, ``synthetic`` and ``report``. Nothing else is left, also after a failure.
    """
    with run_scope(spark):
        people = materialise(read_people(spark, path, n_records, order_by, **(reader or {})), "people")
        write_table(column_catalogue({"input": people}), f"{output}/catalogue")
        prepared = prepare_features(people, as_of)
        write_table(prepared.table, f"{output}/processed")
        processed = spark.read.schema(prepared.table.schema).parquet(f"{output}/processed")
        write_features(split_features(processed, prepared.roles, find_column(people, "Id")), f"{output}/features")
        save_params(prepared.scaler, f"{output}/scaler")
        save_params(prepared.codes, f"{output}/codes")
        tables, report = anonymise(people, as_of, mapping_path=f"{output}/mapping", mode=mode, synthesis=synthesis, **options)
        for name, table in tables.items():
            write_table(table, f"{output}/{name}")
        write_report(report, f"{output}/report")
    return read_report(spark, f"{output}/report")
