import re

from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators.ordered import fill_directional, with_row_index
from veilframe.session import materialise_bucketed


def exchanges(df):
    plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    return sorted(re.findall(r"(?:Broadcast)?Exchange \w+", plan))


def test_stored_ranges_are_not_shuffled_again(spark):
    df = spark.range(4_000).select("id", F.when(F.col("id") % 9 == 5, F.col("id")).alias("x"), F.when(F.col("id") == 3_777, "y").alias("y y"))
    done = fill_directional(df, ["id"], ranges=6)
    # What is left is the carry table of a row for each range.
    assert [e for e in exchanges(done) if "hashpartitioning" in e or "range" in e.lower()] == []
    got = done.orderBy("id").collect()
    assert {r["y y"] for r in got} == {"y"} and [r["x"] for r in got[:7]] == [5] * 7 and got[20]["x"] == 14 and got[-1]["x"] == 3_992


def test_groups_and_ranges_that_share_buckets(spark):
    df = spark.range(900).select("id", (F.col("id") % 4).alias("g"), F.when(F.col("id") % 50 < 3, F.col("id")).alias("x"))
    many, one = (fill_directional(df, ["id"], ["g"], ranges=n) for n in (25, 1))
    assert rows(many) == rows(one)
    assert [e for e in exchanges(many) if "_range" in e] == []


def test_odd_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 5, None)], "`a.b` int, `c,d` int, `E f` string")
    kept = materialise_bucketed(df, "odd", "a.b", 4)
    assert kept.columns == df.columns and rows(kept) == rows(df)
    assert rows(fill_directional(df.withColumnRenamed("a.b", "k"), ["k"], columns=["c,d", "E f"])) == [(1, 5, "b"), (2, 5, "b")]
    empty = df.withColumnRenamed("a.b", "k").where("k > 5")
    assert fill_directional(empty, ["k"], columns=["c,d"]).count() == 0 and with_row_index(empty, ["k"]).count() == 0
