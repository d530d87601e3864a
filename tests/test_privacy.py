import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators import lookup
from veilframe.operators import privacy as V

SCHEMA = "AGE bigint, ZIP string, GENDER string"
FRAME = [(25, "02101", "M"), (30, "02101", "F"), (25, "02101", "M"), (35, "10001", "F"), (30, "10001", "M"), (25, "10001", "F")]
QI = ["AGE", "ZIP"]


def test_small_frame(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    assert rows(V.k_anonymity(df, QI)) == [(10, False, 1, 5, 5), (2, False, 1, 5, 4), (20, False, 1, 5, 5), (5, False, 1, 5, 5)]
    assert rows(V.l_diversity(df, QI, ["GENDER"])) == [(v, False, 0, 5, 0.0) for v in (2, 3, 5)]
    assert rows(V.t_closeness_detail(df, QI, ["GENDER"])) == [(t, False, 0, 5, 0.0, "GENDER", 0.5) for t in (0.1, 0.2, 0.3)]
    (risk,) = V.reidentification_risk(df, QI).collect()
    assert tuple(risk) == (6, 5, pytest.approx(5 / 6), "HIGH")


def test_null_keys_and_null_values(spark):
    df = spark.createDataFrame([*FRAME, (None, "10001", "F"), (99, "x", None), (99, "x", None)], SCHEMA)
    assert V.k_anonymity(df, QI).first()["total_groups"] == 6
    assert tuple(V.reidentification_risk(df, QI).first())[:2] == (9, 7)
    assert V.equivalence_classes(df, QI, null_keys="group").count() == 7
    detail = V.t_closeness_detail(df, QI, ["GENDER"]).first()
    assert detail["total_groups"] == 6
    empty = df.withColumn("GENDER", F.lit(None).cast("string"))
    assert {tuple(r)[1:5] for r in V.t_closeness(empty, QI, ["GENDER"]).collect()} == {(True, 6, 6, 1.0)}


def test_a_quasi_identifier_may_be_sensitive_too(spark):
    """Within its own class it has one value; the other attributes are as without it."""
    df = spark.createDataFrame(FRAME, SCHEMA)
    assert rows(V.l_diversity(df, QI, ["ZIP"]).select("l", "l_diverse_groups")) == [(2, 0), (3, 0), (5, 0)]
    assert V.privacy_report(df, QI, ["GENDER", "ZIP"]).filter("metric = 't_closeness'").count() > 0


def test_bad_arguments(spark):
    df = spark.createDataFrame(FRAME, SCHEMA)
    with pytest.raises(ValueError):
        V.k_anonymity(df, [])
    with pytest.raises(ValueError):
        V.k_anonymity(df, ["NOPE"])
    with pytest.raises(ValueError):
        V.equivalence_classes(df, QI, null_keys="other")


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(V.k_anonymity(df, QI, [2])) == [(2, False, None, 0, 0)]
    assert rows(V.l_diversity(df, QI, ["GENDER"], [2])) == [(2, False, 0, 0, 0.0)]
    assert tuple(V.reidentification_risk(df, QI).first()) == (0, 0, None, "LOW")


def test_stored_report_arithmetic(spark):
    """998 classes of one record and one class of two, over 1,000 records."""
    df = spark.range(1_000).select(F.least(F.col("id"), F.lit(998)).alias("q"))
    k2 = V.k_anonymity_detail(df, ["q"]).filter("k = 2").first().asDict()
    assert k2 == {
        "k": 2, "achieved": False, "min_group_size": 1, "max_group_size": 2, "total_groups": 999,
        "groups_below_k": 998, "groups_meeting_k": 1, "percentage_meeting_k": pytest.approx(0.1, abs=1e-3),
    }
    risk = V.risk_detail(df, ["q"]).first().asDict()
    assert risk == {
        "total_records": 1000, "unique_combinations": 999, "single_records": 998, "small_groups_1_3": 999,
        "medium_groups_4_10": 0, "large_groups_10_plus": 0, "single_record_risk_percentage": pytest.approx(99.8),
        "small_group_risk_percentage": pytest.approx(99.9), "overall_risk_level": "HIGH",
    }


def _closeness_by_hand(data, n_qi, ts):
    """Plain loops over groups and values, in exact fractions."""
    n_sens = len(data[0]) - n_qi
    groups = defaultdict(list)
    for row in data:
        if None not in row[:n_qi]:
            groups[row[:n_qi]].append(row[n_qi:])
    overall = [Counter(r[n_qi + i] for r in data if r[n_qi + i] is not None) for i in range(n_sens)]
    out = []
    for t in ts:
        close = 0
        for members in groups.values():
            distances = []
            for i in range(n_sens):
                here = Counter(m[i] for m in members if m[i] is not None)
                n, n_g = sum(overall[i].values()), sum(here.values())
                gap = sum(abs(Fraction(c, n) - (Fraction(here[v], n_g) if n_g else 0)) for v, c in overall[i].items())
                distances.append(gap / 2)
            close += all(d <= Fraction(str(t)) for d in distances)
        out.append((t, close, len(groups)))
    return out


@pytest.mark.parametrize("seed,heavy", [(1, 1000), (2, 2), (3, 0)])
def test_closeness_against_loops(spark, monkeypatch, seed, heavy):
    """Also with few or no heavy keys, so that both ways through the join are taken."""
    monkeypatch.setattr(lookup, "HEAVY_LIMIT", heavy)
    rng = random.Random(seed)
    data = [
        (
            "hot" if rng.random() < 0.35 else rng.choice(["a", "b", "c", None]),
            rng.choice([1, 2, 3]),
            rng.choice(["x", "x", "x", "y", "z", None]),
            rng.choice([0.0, -0.0, 0.5, 2.5, None]),
        )
        for _ in range(400)
    ] + [("lonely", 9, None, None)]
    df = spark.createDataFrame(data, "q string, p int, s string, v double")
    ts = [0.1, 0.2, 0.3, 0.5]
    got = [(r["t"], r["t_close_groups"], r["total_groups"]) for r in V.t_closeness(df, ["q", "p"], ["s", "v"], ts).collect()]
    assert got == _closeness_by_hand(data, 2, ts)


def test_fixture_counts(spark, medium_person):
    qi = ["race", "state", "city"]
    close = [r["t_close_groups"] for r in V.t_closeness(medium_person, qi, ["gender", "marital"]).collect()]
    assert close == [34, 79, 109]  # plain doubles would give 104 at the end
    assert [r["groups_below_k"] for r in V.k_anonymity(medium_person, qi).collect()] == [0, 0, 35, 123]
    assert [r["groups_below_k"] for r in V.k_anonymity(medium_person, [*qi, "zip"]).collect()] == [0, 0, 38, 124]
    assert V.reidentification_risk(medium_person, [*qi, "zip"]).first()["unique_combinations"] == 176


def test_monotone_and_independent_of_partitioning(spark, medium_person):
    qi, sens = ["race", "city", "gender"], ["marital"]
    reports = [rows(V.privacy_report(medium_person.repartition(n), qi, sens)) for n in (1, 17)]
    assert reports[0] == reports[1]
    ls = [r["ratio"] for r in V.l_diversity(medium_person, qi, sens, [1, 2, 3, 4]).collect()]
    ts = [r["ratio"] for r in V.t_closeness(medium_person, qi, sens, [0.05, 0.1, 0.3, 0.6, 1.0]).collect()]
    achieved = [r["achieved"] for r in V.k_anonymity(medium_person, qi, [1, 2, 3, 5]).collect()]
    assert ls == sorted(ls, reverse=True) and ts == sorted(ts) and ts[-1] == 1.0
    assert all(a or not b for a, b in itertools.pairwise(achieved))
    single = V.t_closeness_detail(medium_person.withColumn("one", F.lit(1)), ["one"], sens).first()
    assert single["average_distance"] == 0.0


def test_report_equals_single_metrics(spark, medium_person):
    qi, sens = ["race", "city", "zip"], ["gender", "marital"]
    report = {(r["metric"], r["param"], r["field"]): r["value_num"] for r in V.privacy_report(medium_person, qi, sens).collect()}
    for r in V.k_anonymity(medium_person, qi).collect():
        assert report["k_anonymity", f"k={r['k']}", "groups_below_k"] == r["groups_below_k"]
    for r in V.t_closeness(medium_person, qi, sens).collect():
        assert report["t_closeness", f"t={r['t']}", "t_close_groups"] == r["t_close_groups"]
    assert report["reidentification_risk", None, "total_records"] == medium_person.count()
