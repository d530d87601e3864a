import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from veilframe.operators import forest
from veilframe.operators.models import model_utility


def table(spark, n, start=0):
    """Three numbers, one with many values and one with two; the label follows from two of them but for noise."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    df = spark.range(start, start + n).select("id", u(1).alias("x"), (u(2) < 0.01).cast("double").alias("y"), F.floor(u(3) * 12).cast("double").alias("z"), u(4).alias("noise"))
    label = F.when(F.col("noise") < 0.2, F.col("id") % 3).otherwise(F.floor(F.col("x") * 3))
    return VectorAssembler(inputCols=["x", "y", "z"], outputCol="features").transform(df).select("features", label.cast("double").alias("label"))


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_the_forest_is_the_same_wherever_it_is_grown(spark):
    """Split over all tasks down to small nodes, or grown in one task; cells in any partitions."""
    train, test = table(spark, 1500), table(spark, 700, 10_000)
    whole = result(forest.forest_scores(train, test, 3, 3, trees=6, max_depth=30))
    assert sum(r[1] for r in whole) == 700
    assert whole == result(forest.forest_scores(train.repartition(7), test.repartition(5), 3, 3, trees=6, max_depth=30))
    assert whole == result(forest.forest_scores(train, test, 3, 3, trees=6, max_depth=30, part_cells=40))
    assert sum(r[1] for r in whole if r[0] == r[2]) > 0.7 * 700
    flat = result(forest.forest_scores(train, test, 3, 3, trees=6, max_depth=2, part_cells=40))
    assert flat == result(forest.forest_scores(train, test, 3, 3, trees=6, max_depth=2)) != whole


def test_large_noise_is_grown_to_pure_leaves(spark):
    """A hundred deep trees on labels that follow from nothing: rows seen are known, and no histogram is kept for each small node."""
    df = table(spark, 20_000).select("features").withColumn("label", F.pmod(F.xxhash64("features", F.lit("n")), F.lit(2)).cast("double"))
    scores = forest.forest_scores(df, df, 3, 2, trees=100, max_depth=30).agg(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("rows"))), F.sum("rows")).first()
    assert scores[1] == 20_000 and 0.55 * 20_000 < scores[0] <= 20_000


def test_model_utility_does_not_depend_on_partitions(spark):
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    df = spark.range(900).select("id", u(1).alias("x"), u(2).alias("y"), F.when(u(3) < 0.5, "a").otherwise("b").alias("gender"))
    found = [model_utility(d, d, "id", models=["random_forest"], trees=7, small_rows=0).first() for d in (df.coalesce(1), df.repartition(9))]
    assert found[0] == found[1] and 0 < found[0]["auc_original"] < 1


def test_thresholds_keep_few_values_apart(spark):
    df = spark.range(5000).select(F.when(F.col("id") == 7, 1.0).otherwise(0.0).alias("rare"), F.col("id").cast("double").alias("many"), F.lit(3.0).alias("one"))
    rare, many, one = forest.thresholds(df, ["rare", "many", "one"])
    assert rare == [0.5] and one == [] and 25 <= len(many) < forest.BINS


def test_draws_of_a_cell_are_poisson():
    u = (np.arange(40_000) + 0.5) / 40_000
    for mean in (1, 3, 400, 1_000_000):
        drawn = forest.poisson(u[:, None], np.full(len(u), mean)).ravel()
        assert abs(drawn.mean() - mean) < 0.02 * mean**0.5 and abs(drawn.var() / mean - 1) < 0.02


def test_best_cuts_against_all_splits():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 4, (20, 2, forest.BINS, 3)) * (rng.random((20, 1, forest.BINS, 1)) < 0.2)
    counts[:, 1] = 0
    counts[:, 1, 4] = counts[:, 0].sum(1)  # the second feature cannot be cut
    gini = lambda c: c.sum() - (c * c).sum() / max(c.sum(), 1)
    for node, (best, cut) in zip(counts, zip(*forest._best_cuts(counts.astype(float)))):
        gains = [gini(node[0].sum(0)) - gini(node[0, : k + 1].sum(0)) - gini(node[0, k + 1 :].sum(0)) for k in range(forest.BINS - 1)]
        assert best == (0 if max(gains) > 1e-9 else -1)
        assert best < 0 or abs(gains[cut] - max(gains)) < 1e-9
