import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

from veilframe.operators import charts as I
from veilframe.operators import utility as U
from veilframe.operators.models import model_utility, pick_target
from veilframe.plans.person import SHIFTED_PERSON_SQL, variant


@pytest.fixture()
def shifted(spark):
    return variant(spark, SMALL, SHIFTED_PERSON_SQL)


def test_similarity_of_a_table_with_itself(small_person):
    out = {r["column"]: r for r in U.similarity(small_person, small_person).collect()}
    assert out["overall"]["similarity_score"] == 1.0 and out["overall"]["columns_compared"] == 2


def test_similarity_without_numbers_or_rows(spark):
    text = spark.createDataFrame([("a",)], "s string")
    assert U.similarity(text, text).count() == 0
    one = spark.createDataFrame([(1.0,)], "x double")
    assert {r["similarity_score"] for r in U.similarity(one, one).collect()} == {None}  # no deviation of one row


def test_fidelity_with_a_constant_column(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 4.0, 5.0)], "k int, x double, c double")
    b = a.withColumn("x", F.col("x") + 1)
    out = {r["column"]: r for r in U.matrix_fidelity(a, b, "k").collect()}
    assert out["overall"]["mae"] == 0.5 and out["overall"]["correlation_mae"] == 0.0
    assert (out["c"]["std_real"], out["x"]["mean_synthetic"]) == (0.0, pytest.approx(10 / 3))


def test_wide_tables(spark):
    """Plans that do not grow with the square of the width, or run out of it."""
    import time

    wide = spark.range(10).select("id", *[(F.col("id") * (i + 1) % 7).cast("double").alias(f"c{i}") for i in range(80)])
    start = time.perf_counter()
    out = U.matrix_fidelity(wide, wide, "id").filter("column = 'overall'").first()
    assert out["correlation_mae"] == 0.0 and time.perf_counter() - start < 60


def test_quality_and_comparison(small_person, shifted):
    quality = {(r["metric"], r["column"], r["key"]): r["value"] for r in U.synthetic_quality(shifted).collect()}
    assert quality["rows", None, None] == 150 and quality["data_types", None, "double"] == 2
    assert quality["categorical_stats", "gender", "M"] + quality["categorical_stats", "gender", "F"] == 150
    other = shifted.filter("gender = 'M'").drop("ssn").withColumn("extra", F.lit(1))
    found = {(r["metric"], r["column"]): r["value"] for r in U.compare_tables(small_person, other).collect()}
    assert found["row_ratio", None] == pytest.approx(other.count() / 150)
    assert (found["common_columns", None], found["column_overlap", None]) == (13, pytest.approx(13 / 14))


def test_models(spark):
    """A label that follows from a number is found; a shuffled copy loses it."""
    df = spark.range(600).select(
        "id", (F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 < 5, "a").otherwise("b").alias("gender")
    )
    noise = df.withColumn("gender", F.when(F.xxhash64("id") % 2 == 0, "a").otherwise("b"))
    same = {r["model"]: r for r in model_utility(df, df, "id", trees=5, max_depth=3).collect()}
    assert set(same) == {"random_forest", "logistic_regression"}
    for r in same.values():
        assert r["accuracy_original"] > 0.95 and r["accuracy_difference"] == 0 and r["utility_preserved"] and r["auc_original"] > 0.95
    lost = model_utility(df, noise, "id", models=["random_forest"], trees=5, max_depth=3).first()
    assert lost["accuracy_synthetic"] < 0.8 and not lost["utility_preserved"]
    assert pick_target(df, df) == "gender" and pick_target(df, df.drop("gender")) is None
    assert model_utility(df, df.drop("gender"), "id").count() == 0
    three = df.withColumn("gender", (F.col("id") % 3).cast("string"))
    assert model_utility(three, three, "id", models=["logistic_regression"]).first()["auc_original"] is None


def test_trees_grow_deep_enough(spark):
    """The classes alternate along a feature: every level cuts off an end, so that ten levels are too few."""
    df = spark.range(3_000).select("id", (F.col("id") % 30).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("gender"))
    deep, flat = (
        model_utility(df, df, "id", models=["random_forest"], trees=5, **depth).first()["accuracy_original"] for depth in ({}, {"max_depth": 10})
    )
    assert deep > 0.95 and flat < 0.85


def test_histograms_keep_every_value(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,), (None,)], "x double")
    out = rows(I.histogram({"a": df}, "x", bins=2), "series", "bin", "count")
    assert out == [("a", 1, 1), ("a", 2, 3)]
    dense = I.density_histogram({"a": df, "b": df.filter("x = 1")}, bins=4).collect()
    assert sum(r["count"] for r in dense if r["series"] == "a") == 4
    assert sum(r["density"] for r in dense if r["series"] == "a") * 0.25 == pytest.approx(1)
    assert [(r["bin"], r["count"]) for r in dense if r["series"] == "b" and r["count"]] == [(1, 2)]
    assert I.histogram({"a": df.filter("x is null")}, "x").count() == 0


def test_box(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    r = I.box_stats({"a": df}, "X").first()
    assert (r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"], r["outliers"]) == (2, 3, 4, 1, 4, 1)


def test_registered_validation_trains_both_models(spark):
    """Random forest and logistic regression have a row for every field in a registered validation."""
    from veilframe.plans.catalog import QUERIES

    found = {r["param"] for r in QUERIES["validate_with_models"](spark, SMALL).filter("metric = 'ml_performance'").collect()}
    assert found == {"model=random_forest", "model=logistic_regression"}
