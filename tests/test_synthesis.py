import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators import synthesis as G
from veilframe.operators.features import generalise_birthdate
from veilframe.operators.roles import assign_roles
from veilframe.operators.utility import holdout_split, similarity
from veilframe.schema import PERSON_COLUMNS, PERSON_SCHEMA

CONDITION = ["gender", "healthcare_expenses", "healthcare_coverage", "age_group"]
TARGET = ["city", "zip", "race", "age"]


@pytest.fixture(scope="module")
def aged(spark):
    from conftest import MEDIUM
    from veilframe.plans.person import person

    return generalise_birthdate(person(spark, MEDIUM), "2024-01-01")


def test_conditions_stay_and_targets_come_from_the_cell(aged):
    model = G.fit_conditional(aged, "id", ["gender", "age_group"], TARGET, min_cell=30)
    out = G.sample_conditional(model)
    assert rows(out, "id", "gender", "age_group") == rows(aged, "id", "gender", "age_group")
    seen = {(r["gender"], r["age_group"], c, r[c]) for r in aged.collect() for c in TARGET}
    assert {(r["gender"], r["age_group"], c, r[c]) for r in out.collect() for c in TARGET} <= seen
    # Independent draws: whole tuples are not simply carried over.
    assert len(set(rows(out, "id", *TARGET)) & set(rows(aged, "id", *TARGET))) < 30


def test_draws_ignore_partitioning_and_slots(aged):
    one = G.sample_conditional(G.fit_conditional(aged.repartition(1), "id", CONDITION, TARGET, slots=1))
    two = G.sample_conditional(G.fit_conditional(aged.repartition(17), "id", CONDITION, TARGET, slots=500))
    assert rows(one, *sorted(one.columns)) == rows(two, *sorted(two.columns))
    other = G.sample_conditional(G.fit_conditional(aged, "id", CONDITION, TARGET), seed=7)
    assert rows(one, "id", *TARGET) != rows(other, "id", *TARGET)


def test_small_cells_back_off(spark):
    data = [(i, "F" if i % 2 else "M", "a" if i < 90 else "b", f"v{i}") for i in range(100)] + [(100, "X", "a", "v100"), (101, "Y", "c", "v101")]
    df = spark.createDataFrame(data, "id int, gender string, age_group string, t string")
    model = G.fit_conditional(df, "id", ["gender", "age_group"], ["t"], min_cell=10)
    cells = dict(rows(model.rows, "id", "cell"))
    sizes = dict(rows(model.rows, "id", "size"))
    assert (cells[0], sizes[0]) == ("0|M|a", 45)  # enough rows of its own
    assert (cells[99], sizes[99]) == ("1|b", 10)  # age group
    assert (cells[100], sizes[100]) == ("1|a", 91)
    assert (cells[101], sizes[101]) == ("2", 102)  # everyone
    ranks = rows(model.donors.groupBy("cell").agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank")))
    assert all(n == high == distinct and low == 1 for _, n, low, high, distinct in ranks)


def test_no_row_is_lost_to_its_key(spark):
    """Null and repeated keys: a row for each row, dense ranks in every cell, no empty draw."""
    data = [(None if i % 3 == 0 else f"k{i % 40}", "F" if i % 2 else "M", "a", f"v{i}") for i in range(150)]
    df = spark.createDataFrame(data, "id string, gender string, age_group string, t string")
    model = G.fit_conditional(df.repartition(7), "id", ["gender", "age_group"], ["t"], min_cell=10)
    out = G.sample_conditional(model)
    assert rows(out, "id", "gender", "age_group") == rows(df, "id", "gender", "age_group")
    assert out.filter("t IS NULL").count() == 0
    ranks = rows(model.donors.groupBy("cell").agg(F.count("*"), F.min("rank"), F.max("rank"), F.count_distinct("rank")))
    assert all(n == high == distinct and low == 1 for _, n, low, high, distinct in ranks) and sum(r[1] for r in ranks) == 150
    again = G.sample_conditional(G.fit_conditional(df.repartition(2), "id", ["gender", "age_group"], ["t"], min_cell=10))
    assert rows(out) == rows(again)


def test_any_number_of_rows(spark, aged):
    model = G.fit_conditional(aged, "id", CONDITION, TARGET)
    for n in (0, 7, 4_000):
        assert G.sample_conditional(model, n=n).count() == n
    pairs = set(rows(aged, "gender", "healthcare_expenses", "healthcare_coverage", "age_group"))
    assert set(rows(G.sample_conditional(model, n=500), "gender", "healthcare_expenses", "healthcare_coverage", "age_group")) <= pairs


def test_identities(spark):
    df = spark.range(1_200).select(F.format_string("k%05d", "id").alias("k"), F.lit("x").alias("maiden"))
    out = G.synthetic_identities(df.repartition(5), "k").orderBy("Id").collect()
    assert [r["Id"] for r in out] == [f"synth_{i:06d}" for i in range(1_200)]
    assert {r["FIRST"] for r in out} >= {"Synthetic_First_007", "Synthetic_First_1199"}
    assert all(re.match(r"^[1-9]\d\d-[1-9]\d-[1-9]\d{3}$", r["SSN"]) for r in out)
    parts = [tuple(map(int, r["SSN"].split("-"))) for r in out]
    assert all(100 <= a <= 998 and 10 <= b <= 98 and 1000 <= c <= 9998 for a, b, c in parts)
    assert {r["maiden"] for r in out} == {"maiden".upper() + "_Redacted"}


def test_synthetic_table_has_the_canonical_layout(spark, small_person):
    out = G.synthesise(small_person, "2024-01-01", n=300)
    assert out.columns == list(PERSON_COLUMNS) and out.count() == 300
    assert G.conform(spark.createDataFrame([], "x int, id string")).schema["LAT"].dataType == PERSON_SCHEMA["LAT"].dataType
    roles = assign_roles(small_person)
    assert "gender" in roles.critical_features


def test_synthetic_numbers_resemble_the_original(aged):
    out = G.sample_conditional(G.fit_conditional(aged, "id", ["gender", "age_group"], ["age", "city"]))
    score = similarity(aged.select("age"), out.select("age")).filter("column = 'overall'").first()
    assert score["similarity_score"] > 0.95


def test_holdout_share_and_stability(aged):
    one, two = (rows(holdout_split(aged.repartition(n), "id"), "id", "is_test") for n in (1, 17))
    assert one == two and 0.25 < sum(t for _, t in one) / len(one) < 0.35
