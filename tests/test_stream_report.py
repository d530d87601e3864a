import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators.privacy import merged_profile, privacy_report, value_profile
from veilframe.session import scratch_path
from veilframe.sources.files import names_in
from veilframe.streaming.dropfolder import latest_report, report_batch
from veilframe.streaming.profile_state import ProfileState, spans

QI, SENSITIVE = ["race", "state"], ["gender", "marital"]


def test_spans_cover_all_batches():
    for n in range(200):
        found = [b for first, size in spans(n) for b in range(first, first + size)]
        assert found == list(range(n)) and len(spans(n)) == bin(n).count("1")
        assert all(first % size == 0 for first, size in spans(n))


def test_state_over_many_batches_some_of_them_repeated(spark):
    """Every batch may fail anywhere and run again, and then with other rows: the last attempt counts."""
    rng = random.Random(2)
    path, schema = scratch_path(spark, "state"), "race string, state string, gender string, marital string"
    state, taken = ProfileState(spark, path, QI), []
    for number in range(9):
        for attempt in range(rng.choice([1, 1, 2])):
            batch = [tuple(rng.choice(["a", "b", None]) for _ in range(4)) for _ in range(rng.randint(0, 6))]
            state.add(value_profile(spark.createDataFrame(batch, schema), QI, SENSITIVE), number)
        taken += batch
        if number in (0, 2, 5, 7, 8):
            whole = value_profile(spark.createDataFrame(taken, schema), QI, SENSITIVE)
            assert rows(state.upto(number)) == rows(whole)
            assert len(names_in(spark, path)) <= 2 * (number + 1).bit_length()
    assert ProfileState(spark, f"{path}/other", QI).upto(3) is None


def test_batches_without_files_between(spark):
    one = spark.createDataFrame([("a", "b", "c", "d")], "race string, state string, gender string, marital string")
    state = ProfileState(spark, scratch_path(spark, "state"), QI)
    for number in (0, 3, 4):
        state.add(value_profile(one, QI, SENSITIVE), number)
    assert {r["_rows"] for r in state.upto(4).collect()} == {3}


def test_reports_follow_the_batches(spark, small_person):
    report = scratch_path(spark, "reports")
    assert latest_report(spark, report) is None
    parts = [small_person.filter(F.pmod(F.hash("id"), F.lit(3)) == k) for k in range(3)]
    for number in (0, 1, 1, 2, 2):
        report_batch(parts[number], number, report, QI, SENSITIVE)
        so_far = small_person.filter(F.pmod(F.hash("id"), F.lit(3)) <= number)
        assert rows(latest_report(spark, report).drop("dataset")) == rows(privacy_report(so_far, QI, SENSITIVE))
    with pytest.raises(ValueError, match="sensitive"):
        report_batch(parts[0], 3, report, QI, ["absent"])


def test_merged_profiles_add_up(spark, small_person):
    whole = value_profile(small_person, QI, SENSITIVE)
    halves = [value_profile(small_person.filter(c), QI, SENSITIVE) for c in ("gender = 'M'", "gender <> 'M'")]
    assert rows(merged_profile(halves[0].unionByName(halves[1]), QI)) == rows(whole)
