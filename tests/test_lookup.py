from pyspark.sql import functions as F

from veilframe.operators.lookup import spread_join


def test_rows_of_heavy_and_null_keys_spread(spark):
    """Two keys of three are heavy or null; their rows go to many partitions, and every row gets its value."""
    rows = spark.range(8000).select(F.when(F.col("id") % 4 == 0, F.col("id")).when(F.col("id") % 4 == 1, F.lit(None)).otherwise(-1).alias("k"), "id")
    table = spark.range(-1, 8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    saved = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spread_join(rows, table, table.where("k = -1"), ["k"], ["v"], ["id"])
        got = joined.select("k", "v", F.spark_partition_id().alias("p")).toPandas()
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)
    known = got[got.k.notna()]
    assert len(got) == 8000 and (known.v == 2 * known.k).all() and got[got.k.isna()].v.isna().all()
    for part in (got[got.k == -1], got[got.k.isna()]):
        assert part.p.nunique() > 1 and part.p.value_counts().max() < len(part) / 2
