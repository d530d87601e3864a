"""Readers and writers of person tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators.ordered import with_row_index
from veilframe.operators.shape import nan_to_null
from veilframe.schema import PERSON_SCHEMA
from veilframe.sources.split_csv import largest_file, read_split_csv

#: A multi-line CSV file above this size is not left to one task.
SPLIT_BYTES = 256 << 20
# Spellings a CSV cell may use for a missing value.
MISSING_TEXT = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def normalise_missing(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN and the usual texts become NULL."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        df = df.withColumns({c: F.when(~F.col(c).isin(*MISSING_TEXT), F.col(c)) for c in texts})
    return nan_to_null(df)


def first_rows(df: DataFrame, n: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order_by`` order (the first stored ones without one, the same at every use).

    One plan for every ``n``; no task gathers the rows.
    """
    return with_row_index(df, order_by, "_row").filter(F.col("_row") < n).drop("_row")


def read_people(
    spark: SparkSession,
    path: str,
    n_records: int | None = None,
    order_by: Sequence[str] = (),
    schema: T.StructType | str | None = PERSON_SCHEMA,
    fmt: str = "csv",
    multi_line: bool = True,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """A person table from CSV with header (or parquet). ``schema=None`` infers the types.

    Quoted cells may hold newlines. Spark's reader cannot split such files, so where a schema is given and a file is larger than
    ``split_bytes``, ``read_split_csv`` reads them by many tasks; its quotes have to be balanced. A caller who knows that no cell
    holds a newline turns ``multi_line`` off.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv" and multi_line and schema is not None and largest_file(spark, path) > split_bytes:
        df = normalise_missing(read_split_csv(spark, path, spark.createDataFrame([], schema).schema))
        return first_rows(df, n_records, order_by) if n_records is not None else df
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None).option("escape", '"').option("enforceSchema", False)
        reader = reader.option("multiLine", multi_line)
    loaded = reader.format(fmt).load(path)
    df = normalise_missing(loaded) if fmt == "csv" else nan_to_null(loaded)
    return first_rows(df, n_records, order_by) if n_records is not None else df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
        # The writer would trim cells otherwise, also newlines at their ends.
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)
