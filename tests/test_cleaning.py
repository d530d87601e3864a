import math
import random
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators import clean as C
from veilframe.operators.ordered import fill_directional, with_row_index
from veilframe.operators.profile import describe_numeric, missing_by_column, profile_table
from veilframe.operators.quantiles import exact_quantiles


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "a"), (3, "b"), (10, "b"), (None, None), (None, None)], "n int, s string"
    ).withColumns({"none": F.lit(None).cast("string"), "nan": F.lit(None).cast("double")})
    assert rows(C.impute_median(df), "n")[-1] == (3.0,) and (2.5,) in rows(C.impute_median(df), "n")
    assert rows(C.impute_mode(df), "s") == [("a",)] * 4 + [("b",)] * 2
    assert rows(C.impute_mode(df), "none") == [("Unknown",)] * 6
    cleaned = C.clean(df)
    assert cleaned.columns == ["n", "s", "none"] and cleaned.filter("n is null or s is null").count() == 0


def test_median_comes_after_duplicate_removal(spark):
    df = spark.createDataFrame([(1.0, "a"), (1.0, "a"), (1.0, "a"), (5.0, "b"), (None, "c")], "x double, s string")
    assert rows(C.clean(df), "x") == [(1.0,), (3.0,), (5.0,)]


def test_sparse_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "2020-01-01"), (4, "2020-01-01")], "i int, d string").select("i", F.col("d").cast("date").alias("d"))
    assert C.drop_sparse_columns(df).columns == ["i", "d"]
    assert C.drop_sparse_columns(df.filter("i <> 4")).columns == ["i"]
    wide = spark.createDataFrame([(1, None, None, None, None), (None,) * 5], "a int, b int, c int, d int, e int")
    assert C.drop_sparse_rows(wide).count() == 1


def _fill(values):
    out, last = [], None
    for v in values:
        last = v if v is not None else last
        out.append(last)
    first = next((v for v in values if v is not None), None)
    return [first if v is None else v for v in out]


@pytest.mark.parametrize("ranges", [1, 3, 17])
def test_directional_fill(spark, ranges):
    df = spark.createDataFrame(list(enumerate([None, 1, None, None, 2, None])), "k int, v int")
    assert [v for _, v in rows(fill_directional(df, ["k"], ranges=ranges))] == [1, 1, 1, 1, 2, 2]


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_directional_fill_in_groups(spark, ranges):
    rng = random.Random(ranges)
    data = [(rng.choice(["a", "a", "a", "b", "c", None]), i, rng.choice([None, None, None, i]), rng.choice([None, None, str(i)])) for i in range(300)]
    df = spark.createDataFrame(data, "g string, k int, v int, s string").repartition(4)
    expected = []
    for g in {d[0] for d in data}:
        mine = sorted(d for d in data if d[0] == g) if g is not None else sorted((d for d in data if d[0] is None), key=lambda d: d[1])
        mine.sort(key=lambda d: d[1])
        expected += zip([g] * len(mine), [d[1] for d in mine], _fill([d[2] for d in mine]), _fill([d[3] for d in mine]))
    assert rows(fill_directional(df, ["k"], partition_by=["g"], ranges=ranges)) == sorted(expected, key=repr)
    whole = sorted(data, key=lambda d: d[1])
    plain = list(zip([d[1] for d in whole], _fill([d[2] for d in whole])))
    assert rows(fill_directional(df, ["k"], ranges=ranges), "k", "v") == sorted(plain, key=repr)


@pytest.mark.parametrize("ranges", [1, 7])
def test_row_index_is_dense_and_ordered(spark, ranges):
    df = spark.range(1_000).select((F.col("id") * 7919 % 1_000).alias("k"), (F.col("id") % 3).alias("hot"))
    assert rows(with_row_index(df, ["k"], ranges=ranges), "k", "row_index") == sorted([(k, k) for k in range(1_000)], key=repr)
    hot = [r["hot"] for r in with_row_index(df, ["hot", "k"], ranges=ranges).orderBy("row_index").collect()]
    assert hot == sorted(hot)


@pytest.mark.parametrize("small,accuracy", [(20_000, 10_000), (20, 100)])
@pytest.mark.parametrize("shape", ["uniform", "hot", "wide", "few"])
def test_exact_quantiles(spark, shape, small, accuracy):
    """Small limits force many narrowing rounds."""
    rng = random.Random(5)
    make = {
        "uniform": lambda: rng.uniform(-50, 50),
        "hot": lambda: 7.0 if rng.random() < 0.4 else rng.gauss(7, 3),
        "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-200, 200),
        "few": lambda: float(rng.randint(1, 3)),
    }[shape]
    values = [make() for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 50, "x double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, ["x"], probs, small=small, accuracy=accuracy)["x"]
    ordered = sorted(values)
    for p, g in zip(probs, got):
        h = p * (len(ordered) - 1)
        lo, hi = ordered[math.floor(h)], ordered[math.ceil(h)]
        assert min(lo, hi) <= g <= max(lo, hi) and g == pytest.approx(lo + (h - math.floor(h)) * (hi - lo), rel=1e-12)
    assert got[3] == statistics.median(values)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}
    assert tuple(describe_numeric(df).first()) == ("x", 0, None, None, None, None, None, None, None)
    assert describe_numeric(df, approximate=True).first()["p50"] is None


def test_approximate_describe_is_close(spark, medium_person):
    exact, approx = (describe_numeric(medium_person, approximate=a).orderBy("column").collect() for a in (False, True))
    for e, a in zip(exact, approx):
        assert (e["count"], e["min"], e["max"]) == (a["count"], a["min"], a["max"])
        assert abs(e["p50"] - a["p50"]) / e["p50"] < 0.01


def test_profile_counts_nulls_and_copies(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "i int, s string")
    assert tuple(profile_table(df).first()) == (4, 2, 3, 2)
    assert rows(missing_by_column(df)) == [("s", 3, 75.0)]
    assert tuple(profile_table(df.limit(0)).first()) == (0, 2, 0, 0)
    assert rows(C.clean_report(df, C.drop_duplicate_rows(df))) == [("after", 2, 2), ("before", 4, 2)]
