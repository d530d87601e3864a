import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from veilframe.operators import features
from veilframe.plans import workflows as L
from veilframe.session import durable_dir, materialise, run_scope, scratch_path
from veilframe.sources.tables import write_table


def folders(spark):
    return set(os.listdir(durable_dir(spark)))


def test_a_scope_takes_its_own_tables_only(spark):
    before = folders(spark)
    outer = materialise(spark.range(3).toDF("x"), "outer")
    with run_scope(spark):
        one = materialise(spark.range(4).toDF("x"), "one")
        with run_scope(spark):
            two = materialise(one.filter("x > 0"), "two")
            assert two.count() == 3 and scratch_path(spark, "never-written")
        assert one.count() == 4 and len(folders(spark) - before) == 2
    assert outer.count() == 3 and len(folders(spark) - before) == 1


def test_a_failure_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ValueError, match="missing columns"), run_scope(spark):
        materialise(spark.range(2).toDF("x"), "lost")
        features.split_features(spark.range(2).toDF("x"), None, "absent")
    assert folders(spark) == before


@pytest.mark.parametrize("fails", [False, True])
def test_a_run_on_files_leaves_its_results_only(spark, tmp_path, small_person, fails):
    path, out = str(tmp_path / "people"), str(tmp_path / "out")
    write_table(small_person, path, "csv")
    before = folders(spark)
    options = {"synthesis": False, "models": [], "mode": "keyed", "secret": "" if fails else "s", "reader": {"schema": small_person.schema}}
    if fails:
        with pytest.raises(ValueError):
            L.anonymise_files(spark, path, out, "2024-01-01", **options)
    else:
        report = L.anonymise_files(spark, path, out, "2024-01-01", **options)
        assert report.count() > 20 and spark.read.parquet(f"{out}/processed").count() == 150
        assert sorted(os.listdir(out)) == ["catalogue", "codes", "features", "processed", "pseudonymised", "report", "scaler"]
    assert folders(spark) == before


def encoded_plan(spark, columns):
    wide = spark.range(2_000).select("id", *[F.concat(F.lit(f"v{i}-"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(700))).alias(f"c{i}") for i in range(columns)])
    names = [f"c{i}" for i in range(columns)]
    codes = materialise(features.fit_encoder(wide, names), "codes")
    by_broadcast = features.apply_encoder(wide, codes)
    joined = features.apply_encoder(wide, codes, broadcast_bytes=0)
    assert rows(joined) == rows(by_broadcast)
    return joined.select("*")._jdf.queryExecution().executedPlan().toString()  # not run yet: one plan, the initial one


def test_exchanges_do_not_grow_with_the_large_columns(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, six = (encoded_plan(spark, n).count("Exchange hashpartitioning") for n in (1, 6))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert one == six == 4


def test_heavy_and_odd_cells(spark, monkeypatch):
    from veilframe.operators import lookup

    monkeypatch.setattr(lookup, "HEAVY_ROWS", 50)
    df = spark.range(900).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), "id")).alias("a"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise("").alias("b.c"),
    )
    codes = materialise(features.fit_encoder(df.withColumnRenamed("b.c", "b"), ["a", "b"]), "codes")
    df = df.withColumnRenamed("b.c", "b").withColumn("a", F.when(F.col("id") == 1, "unseen").otherwise(F.col("a")))
    assert rows(features.apply_encoder(df, codes, broadcast_bytes=0)) == rows(features.apply_encoder(df, codes))
