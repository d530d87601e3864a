import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.operators.comoments import CoMoments, co_moments
from veilframe.operators.utility import matrix_fidelity


def table_of(seed, n, k, scale=1.0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, k)) * scale + 1e6, rng.random((n, k)) > 0.1


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.integers(0, 9), min_size=1, max_size=5), st.integers(1, 4))
def test_merged_states_are_those_of_all_rows(seed, sizes, k):
    values, valid = table_of(seed, sum(sizes), k)
    bounds = np.cumsum([0, *sizes])
    states = [CoMoments.of(values[a:b], valid[a:b]) for a, b in zip(bounds, bounds[1:])]
    random.Random(seed).shuffle(states)
    done = states[0]
    for other in states[1:]:
        done = done.merge(CoMoments.unpack(other.pack(), k))
    whole = CoMoments.of(values, valid)
    assert (done.known == whole.known).all() and done.rows == whole.rows
    for name in ("squares", "products"):
        assert np.allclose(getattr(done, name), getattr(whole, name), atol=1e-6)
    assert np.allclose(done.mean[done.known > 0], whole.mean[done.known > 0])


def test_states_of_tables_against_numpy(spark):
    rows = [(float(i % 7) * 1e9, None if i % 5 == 0 else float(i * i), 3.0, math.nan if i == 4 else float(-i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, B double, c double, d double")
    one, two, none = co_moments([df.repartition(7), df.where("a = 0"), df.where("false")], ["a", "b", "c", "d"])
    whole = np.array([r for i, r in enumerate(rows) if r[1] is not None and i != 4], float)
    assert one.known.tolist() == [60, 48, 60, 60] and one.rows == len(whole)
    want = np.corrcoef(whole[:, [0, 1, 3]].T)
    assert np.allclose(one.correlations()[np.ix_([0, 1, 3], [0, 1, 3])], want) and np.isnan(one.correlations()[2]).all()
    assert one.mean[0] == pytest.approx(np.mean([r[0] for r in rows])) and one.deviation()[2] == 0
    assert np.isnan(one.deviation()[3]) and two.known[0] == 9
    assert none.rows == 0 and np.isnan(none.deviation()).all() and np.isnan(none.correlations()).all()


def test_wide_tables_take_few_jobs(spark):
    wide = spark.range(2_000).select("id", *[(F.xxhash64("id", F.lit(i)) / 2.0**63).alias(f"c{i}") for i in range(80)])
    other = wide.select("id", *[(F.col(f"c{i}") * 2 + 1).alias(f"c{i}") for i in range(80)])
    spark.sparkContext.setJobGroup("fidelity", "")
    try:
        found = {r["column"]: r for r in matrix_fidelity(wide, other, "id").collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fidelity"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 81 and found["overall"]["correlation_mae"] == pytest.approx(0, abs=1e-9)
    assert found["c3"]["std_synthetic"] == pytest.approx(2 * found["c3"]["std_real"])
    assert 0 < jobs <= 10
