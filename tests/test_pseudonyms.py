import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.functions import masks
from veilframe.operators import pseudonyms as N
from veilframe.session import scratch_path
from veilframe.sources.mapping import load_mapping

SCHEMA = "Id string, SSN string, FIRST string, LAST string, ADDRESS string, CITY string, STATE string, ZIP string"
PEOPLE = [
    ("patient_001", "123-45-6789", "John", "Doe", "123 Main St", "Boston", "MA", "02101"),
    ("patient_002", "987-65-4321", "Jane", "Smith", "456 Oak Ave", "New York", "NY", "10001"),
]
UUID4 = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def test_golden_masks_and_random_ids(spark):
    path = scratch_path(spark, "mapping")
    df = spark.createDataFrame(PEOPLE, SCHEMA)
    out = N.pseudonymise_table(df, path).orderBy("SSN").collect()
    assert [tuple(r)[1:] for r in out] == [
        ("01a-54-629e", "Patient_61409aa1", "ID_ad695f53", "Street_3_Redacted", "Boston", "MA", "021XX"),
        ("ecd-bc-061a", "Patient_2b959933", "ID_e95f770a", "Street_3_Redacted", "New York", "NY", "100XX"),
    ]
    assert all(UUID4.match(r["Id"]) for r in out) and out[0]["Id"] != out[1]["Id"]
    again = N.pseudonymise_table(df, path).orderBy("SSN").collect()
    assert [r["Id"] for r in again] == [r["Id"] for r in out]


def test_blank_rules(spark):
    df = spark.createDataFrame(
        [(None,), ("",), ("Main",), ("   ",), (" 12  Main St ",), ("a b\x1cc",), ("2101.0",), ("12",), ("02101",)], "c string"
    )
    out = df.select(
        masks.mask_ssn(F.col("c")), masks.mask_first_name(F.col("c")), masks.mask_last_name(F.col("c")),
        masks.mask_address(F.col("c")), masks.mask_zip(F.col("c")),
    ).collect()
    assert tuple(out[0]) == (None, "Patient_88183b94", "ID_88183b94", "Address_Redacted", "00000")
    assert tuple(out[1]) == ("", "Patient_88183b94", "ID_88183b94", "Address_Redacted", "00000")
    assert [r[3] for r in out[2:6]] == ["Address_Redacted", "Address_Redacted", "Street_3_Redacted", "Street_3_Redacted"]
    assert [r[4] for r in out[6:]] == ["210XX", "00000", "021XX"]


def test_mapping_grows_without_duplicates(spark):
    path = scratch_path(spark, "mapping")
    first = N.extend_mapping(spark.range(50).toDF("k"), "k", path)
    before = dict(rows(first, "original", "pseudonym"))
    # The same ids as text and as numbers are the same ids.
    both = spark.range(80).select(F.col("id").cast("string").alias("k"))
    after = dict(rows(N.extend_mapping(both, "k", path), "original", "pseudonym"))
    assert len(after) == len(set(after.values())) == 80
    assert all(after[k] == v for k, v in before.items())
    assert rows(N.mapping_stats(load_mapping(spark, path))) == [("person", 80, 80, 0)]


def test_duplicate_keys_are_reported(spark):
    mapping = spark.createDataFrame([("a", "x", "person"), ("a", "y", "person"), ("b", "z", "person")], "original string, pseudonym string, namespace string")
    assert rows(N.mapping_stats(mapping)) == [("person", 3, 2, 1)]


def test_one_id_with_a_third_of_the_rows(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id")
    mapping = N.extend_mapping(df, "k", scratch_path(spark, "mapping"))
    table = mapping.select(F.col("original").alias("k"), "pseudonym")
    plain = rows(df.join(table, "k", "left"), "id", "pseudonym")
    from veilframe.operators.lookup import heavy_keys, lookup_join

    assert heavy_keys(df, "k", min_rows=100) == (["hot"], True)
    assert rows(lookup_join(df, table, "k", min_rows=100), "id", "pseudonym") == plain


def test_keyed_ids_need_no_mapping_and_depend_on_the_secret(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "Id string")
    one, two = (rows(N.pseudonymise_id(df, mode="keyed", secret=s)) for s in ("x", "y"))
    assert one != two and len(set(one)) == 3 and (None,) in one
    assert all(v is None or UUID4.match(v) for (v,) in one)


def test_redaction_and_required_columns(spark):
    df = spark.createDataFrame([(None, 1.5)], "MAIDEN string, lat double")
    assert rows(N.redact(df)) == [("MAIDEN_Redacted", "LAT_Redacted")]
    with pytest.raises(ValueError, match="missing columns"):
        N.mask_columns(df)
    with pytest.raises(ValueError, match="mode"):
        N.pseudonymise_id(spark.createDataFrame(PEOPLE, SCHEMA), mode="other")
