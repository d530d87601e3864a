import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.functions.dates import age_group, age_years, parse_date
from veilframe.operators import features as D
from veilframe.operators.roles import CONTENT_RULES, assign_roles, column_catalogue, role_of
from veilframe.plans.workflows import prepare_features
from veilframe.schema import PERSON_SCHEMA, Roles
from veilframe.session import scratch_path
from veilframe.sources.store import load_params, read_features, save_params, write_features


def test_age_groups(spark):
    ages = [0, 1, 18, 19, 30, 31, 50, 51, 70, 71, 100, 101, -1, None]
    groups = [None, "0-18", "0-18", "19-30", "19-30", "31-50", "31-50", "51-70", "51-70", "70+", "70+", None, None, None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a int")
    assert [r[0] for r in df.orderBy("i").select(age_group(F.col("a"))).collect()] == groups


def test_ages_use_years_of_365_days(spark):
    df = spark.createDataFrame([("2023-01-01",), ("2024-01-02",), ("1924-01-26",), ("nonsense",), ("2023-02-30",), (None,)], "d string")
    out = [r[0] for r in df.select(age_years(parse_date(F.col("d")), dt.date(2024, 1, 1))).collect()]
    assert out == [1, -1, 99 + (36500 <= (dt.date(2024, 1, 1) - dt.date(1924, 1, 26)).days), None, None, None]
    assert D.generalise_birthdate(spark.range(1), "2024-01-01").columns == ["id"]


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5), (None, None), (5.0, 5)], "x double, c int")
    assert rows(D.scale_minmax(df, ["x", "c"])) == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (None, None)]
    out = dict(rows(D.scale_standard(df, ["x", "c"])))
    assert sorted(k for k in out if k is not None) == pytest.approx([-1.5**0.5, 0.0, 1.5**0.5])
    with pytest.raises(ValueError):
        D.apply_scaler(df, D.fit_scaler(df, ["x"]), "other")


@pytest.mark.parametrize("limit", [200_000, 1])
def test_label_codes_follow_code_points(spark, limit):
    """With a limit of one byte the shuffle join is taken."""
    values = ["b", "B", "a", "_", "é", None]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v string, w int")
    codes = D.fit_encoder(df, ["v", "w"])
    expected = {"B": 0, "_": 1, "a": 2, "b": 3, "nan": 4, "é": 5}
    assert dict(rows(codes.filter("column = 'v'"), "value", "code")) == expected
    out = D.apply_encoder(df.withColumn("raw", F.col("v")), codes, broadcast_bytes=limit)
    assert {r["raw"] or "nan": r["v"] for r in out.collect()} == expected


def test_parameters_survive_storage(spark, small_person):
    path = scratch_path(spark, "codes")
    codes = D.fit_encoder(small_person, ["race", "marital"])
    save_params(codes, path)
    again = load_params(spark, path)
    assert rows(D.apply_encoder(small_person, again), "id", "race") == rows(D.encode_label(small_person, ["race"]), "id", "race")
    unseen = spark.createDataFrame([("NEW",)], "race string")
    assert D.apply_encoder(unseen, again).first()["race"] is None


def test_onehot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    out = D.encode(df, ["v"], "onehot", max_levels=5)
    assert out.columns == ["v_a", "v_b"] and rows(out) == [(0, 0), (0, 1), (1, 0)]
    with pytest.raises(ValueError, match="levels"):
        D.encode_onehot(df, ["v"], max_levels=1)
    with pytest.raises(ValueError, match="max_levels"):
        D.encode(df, ["v"], "onehot")
    with pytest.raises(ValueError, match="method"):
        D.encode(df, ["v"], "other")


def test_onehot_names(spark):
    """Dots and names that differ in case only give columns every operator can take."""
    df = spark.createDataFrame([("St. Louis", "a"), ("White", "b"), ("white", None)], "v string, `V_White` string")
    out = D.encode_onehot(df, ["v"], max_levels=5)
    assert out.columns == ["V_White", "v_St_ Louis", "v_White_2", "v_white_3"]
    assert rows(out.select("v_St_ Louis", "v_White_2", "v_white_3")) == [(0, 0, 1), (0, 1, 0), (1, 0, 0)]


def test_roles_of_the_canonical_columns(spark):
    roles = assign_roles(spark.createDataFrame([], PERSON_SCHEMA))
    assert roles == Roles(
        identifiers=("Id", "SSN", "DRIVERS", "PASSPORT", "FIRST", "LAST", "MAIDEN", "ADDRESS"),
        quasi_identifiers=("BIRTHDATE", "RACE", "ETHNICITY", "CITY", "STATE", "COUNTY", "ZIP"),
        critical_features=("GENDER", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE"),
        sensitive_attributes=("MARITAL", "LAT", "LON"),
        numerical_features=("LAT", "LON", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE"),
        categorical_features=tuple(
            c for c in PERSON_SCHEMA.names if c not in ("BIRTHDATE", "DEATHDATE", "LAT", "LON", "HEALTHCARE_EXPENSES", "HEALTHCARE_COVERAGE")
        ),
    )
    names = spark.createDataFrame([(c,) for c in PERSON_SCHEMA.names], "c string")
    content = dict(rows(names.select("c", role_of(F.col("c"), CONTENT_RULES))))
    assert {c for c, r in content.items() if r == "identifiers"} == {"Id", "MAIDEN"}
    assert {c for c, r in content.items() if r == "sensitive"} == {"BIRTHDATE", "SSN", "BIRTHPLACE", "ADDRESS"}
    assert {c for c, r in content.items() if r == "demographic"} == {"MARITAL", "RACE", "ETHNICITY", "GENDER", "HEALTHCARE_COVERAGE"}
    assert sum(r is None for r in content.values()) == 14


def test_catalogue_modes(spark, small_person):
    exact, approx = (column_catalogue({"p": small_person}, distinct=d).orderBy("position").collect() for d in ("exact", "approx"))
    assert [r["n_missing"] for r in exact] == [r["n_missing"] for r in approx]
    assert all(abs(e["n_distinct"] - a["n_distinct"]) <= 0.15 * e["n_distinct"] + 1 for e, a in zip(exact, approx))
    assert column_catalogue({"p": spark.createDataFrame([], "MAIDEN string")}, match="token").first()["role"] == "sensitive_attributes"


def test_features_round_trip_with_names(spark, small_person):
    prepared = prepare_features(small_person, "2024-01-01")
    path = scratch_path(spark, "features")
    write_features(prepared.features, path)
    features, condition, target = read_features(spark, path)
    assert condition == ["gender", "healthcare_expenses", "healthcare_coverage", "age_group"]
    assert target == ["city", "state", "zip", "race", "age"]
    assert features.count() == small_person.count()
    cells = features.select(F.explode(F.concat("condition", "target")).alias("v"))
    assert cells.filter("v is null").count() == 0
    scaled = prepared.table.agg(F.min("age"), F.max("age"), F.min("healthcare_expenses"), F.max("healthcare_expenses")).first()
    assert tuple(scaled) == (0.0, 1.0, 0.0, 1.0)
