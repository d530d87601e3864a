"""Stable pseudonyms for direct identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.operators.lookup import HEAVY_ROWS, heavy_keys
from veilframe.schema import REDACTED, find_column, present, require
from veilframe.session import materialise
from veilframe.sources.mapping import FEW_IDS, Commit, add_rows, table_of

REQUIRED = ("Id", "SSN", "FIRST", "LAST", "ADDRESS", "CITY", "STATE", "ZIP")


def _extended(df: DataFrame, column: str, mapping_path: str, namespace: str) -> tuple[Commit, list[str] | None]:
    """The commit that holds every id of ``df``, and the ids themselves while they are few."""
    spark = df.sparkSession
    ids = materialise(df.select(F.col(column).cast("string").alias("original")).dropna().distinct(), "ids")
    few = [r["original"] for r in ids.limit(FEW_IDS + 1).collect()]
    few = few if len(few) <= FEW_IDS else None

    def missing(known: DataFrame) -> DataFrame:
        # Few ids open the files of their buckets only; many are shuffled to the buckets, which stay where they are.
        held = known.filter(F.col("original").isin(few)) if few is not None else known
        return ids.join(held, "original", "left_anti").select("original", F.uuid().alias("pseudonym"))

    return add_rows(spark, mapping_path, namespace, missing), few


def extend_mapping(df: DataFrame, column: str, mapping_path: str, namespace: str = "person") -> DataFrame:
    """Give every id not yet in the mapping a random UUID; returns the mapping of the namespace.

    A repeated run finds all ids known and adds nothing. Any number of writers may extend one mapping at a time: the first to
    publish an id decides its pseudonym.
    """
    return table_of(df.sparkSession, _extended(df, column, mapping_path, namespace)[0])


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, min_rows: int = HEAVY_ROWS) -> DataFrame:
    """Replace ids by their pseudonyms; of a stored mapping only ``df`` is shuffled, by the id.

    Heavy ids get theirs from a broadcast of at most ``HEAVY_LIMIT`` rows. They and null ids go through the join under keys
    that match nothing and spread over the buckets.
    """
    named = df.withColumn("_original", F.col(column).cast("string"))
    table = mapping.select(F.col("original").alias("_key"), F.col("pseudonym").alias("_pseudonym"))
    heavy, many_nulls = heavy_keys(named, "_original", min_rows)
    if not heavy and not many_nulls:
        joined = named.withColumnRenamed("_original", "_key").join(table, "_key", "left")
        return joined.withColumn(column, F.col("_pseudonym")).select(*df.columns)
    few = table.filter(F.col("_key").isin(heavy) if heavy else F.lit(False)).toDF("_original", "_heavy")
    loose = F.col("_heavy").isNotNull() | F.col("_original").isNull()
    salt = F.concat(F.lit("\0"), F.xxhash64(F.spark_partition_id(), *df.columns).cast("string"))
    salted = named.join(F.broadcast(few), "_original", "left").withColumn("_key", F.when(loose, salt).otherwise(F.col("_original")))
    joined = salted.join(table, "_key", "left")
    return joined.withColumn(column, F.coalesce("_heavy", "_pseudonym")).select(*df.columns)


def pseudonymise_id(
    df: DataFrame,
    column: str = "Id",
    mapping_path: str | None = None,
    namespace: str = "person",
    mode: str = "random",
    secret: str = "",
) -> DataFrame:
    """``mode="random"``: UUIDs kept in the mapping table. ``mode="keyed"``: UUIDs hashed from the id and
    a secret; a pure projection without mapping, join or shuffle, also fit for streams."""
    (column,) = require(df, [column])
    if mode == "keyed":
        return df.withColumn(column, masks.keyed_uuid(F.col(column), secret, namespace))
    if mode != "random":
        raise ValueError("mode must be 'random' or 'keyed'")
    if not mapping_path:
        raise ValueError("random pseudonyms need a mapping_path")
    commit, few = _extended(df, column, mapping_path, namespace)
    mapping = table_of(df.sparkSession, commit)
    if few is None:
        return apply_mapping(df, column, mapping)
    # At most ``FEW_IDS`` rows: neither side is shuffled, and no id is too heavy.
    table = mapping.filter(F.col("original").isin(few)).select(F.col("original").alias("_original"), F.col("pseudonym").alias("_pseudonym"))
    joined = df.withColumn("_original", F.col(column).cast("string")).join(F.broadcast(table), "_original", "left")
    return joined.withColumn(column, F.col("_pseudonym")).select(*df.columns)


def redact(df: DataFrame, cols: tuple[str, ...] = REDACTED) -> DataFrame:
    """Constant text in place of every value, nulls included."""
    found = present(df, cols)
    return df.withColumns({c: F.lit(f"{c.upper()}_Redacted") for c in found}) if found else df


def mask_columns(df: DataFrame, salt: str = "") -> DataFrame:
    """All masks that need no mapping, as one projection; city and state stay as they are."""
    _, ssn, first, last, address, _, _, zip_code = require(df, REQUIRED)
    masked = df.withColumns(
        {
            ssn: masks.mask_ssn(F.col(ssn), salt),
            first: masks.mask_first_name(F.col(first), salt),
            last: masks.mask_last_name(F.col(last), salt),
            address: masks.mask_address(F.col(address)),
            zip_code: masks.mask_zip(F.col(zip_code)),
        }
    )
    return redact(masked)


def pseudonymise_table(
    df: DataFrame,
    mapping_path: str | None = None,
    mode: str = "random",
    secret: str = "",
    salt: str = "",
    namespace: str = "person",
) -> DataFrame:
    """Ids, SSN, names, address, ZIP and redactions together. Takes the raw table: hashes of encoded
    values would mean nothing."""
    masked = mask_columns(df, salt)
    return pseudonymise_id(masked, find_column(df, "Id"), mapping_path, namespace, mode, secret)


def mapping_stats(mapping: DataFrame) -> DataFrame:
    """Mappings per namespace; ``duplicates`` counts surplus rows of an id and must be 0."""
    per_id = mapping.groupBy("namespace", "original").agg(F.count("*").alias("_rows"))
    return per_id.groupBy("namespace").agg(
        F.sum("_rows").alias("total_mappings"),
        F.count("*").alias("distinct_originals"),
        (F.sum("_rows") - F.count("*")).alias("duplicates"),
    )
