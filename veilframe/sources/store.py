"""Stored features and fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_features(features: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(row_key, condition, target); names are kept as column metadata in the parquet schema."""
    features.write.mode(mode).parquet(path)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """(features, condition names, target names)."""
    features = spark.read.parquet(path)
    names = [features.schema[c].metadata.get("names", []) for c in ("condition", "target")]
    return features, names[0], names[1]


def save_params(params: DataFrame, path: str, mode: str = "errorifexists") -> None:
    params.write.mode(mode).parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
