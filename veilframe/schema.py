"""Canonical person schema, column roles and small schema helpers."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The canonical column order of a person table.
PERSON_COLUMNS = (
    "Id", "BIRTHDATE", "DEATHDATE", "SSN", "DRIVERS", "PASSPORT",
    "PREFIX", "FIRST", "LAST", "SUFFIX", "MAIDEN", "MARITAL",
    "RACE", "ETHNICITY", "GENDER", "BIRTHPLACE", "ADDRESS",
    "CITY", "STATE", "COUNTY", "ZIP", "LAT", "LON",
    "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE",
)
_DATES = {"BIRTHDATE", "DEATHDATE"}
_DOUBLES = {"LAT", "LON", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE"}


def _person_type(name: str) -> T.DataType:
    if name in _DATES:
        return T.DateType()
    return T.DoubleType() if name in _DOUBLES else T.StringType()


# ZIP stays a string: inference would turn 02101 into 2101.
PERSON_SCHEMA = T.StructType([T.StructField(c, _person_type(c)) for c in PERSON_COLUMNS])

# Columns the privacy report looks for, and the candidate prediction targets in order.
QUASI_IDENTIFIERS = ("AGE", "ZIP", "RACE", "ETHNICITY", "CITY", "STATE")
SENSITIVE = ("GENDER", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE")
TARGET_CANDIDATES = ("GENDER", "RACE", "ETHNICITY")
REDACTED = ("DRIVERS", "PASSPORT", "MAIDEN", "LAT", "LON")


@dataclass(frozen=True)
class Roles:
    identifiers: tuple[str, ...] = ()
    quasi_identifiers: tuple[str, ...] = ()
    critical_features: tuple[str, ...] = ()
    sensitive_attributes: tuple[str, ...] = ()
    numerical_features: tuple[str, ...] = field(default=())
    categorical_features: tuple[str, ...] = field(default=())


def find_column(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of ``name`` (matched without case), or None."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in (find_column(df, n) for n in names) if c is not None]


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    missing = [n for n in names if find_column(df, n) is None]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return present(df, names)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
