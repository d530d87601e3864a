"""Model-based utility: train on both tables, score on the original's holdout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from veilframe.operators.features import apply_encoder, fit_encoder
from veilframe.operators.forest import forest_scores
from veilframe.operators.utility import common_numeric, holdout_split
from veilframe.schema import TARGET_CANDIDATES, find_column
from veilframe.session import durable_dir, materialise

PRESERVED_GAP = 0.1
#: The deepest tree by default; leaves are pure or of one cell long before.
MAX_DEPTH = 30
#: Spark's own forest, whose cost a node grows with partitions and whose trees the driver holds, learns from so many rows at most.
SMALL_ROWS = 2_000
MODELS = ("random_forest", "logistic_regression")
RESULT_SCHEMA = (
    "model string, target string, accuracy_original double, accuracy_synthetic double, accuracy_difference double, "
    "auc_original double, auc_synthetic double, utility_preserved boolean"
)


def pick_target(original: DataFrame, synthetic: DataFrame, candidates: Sequence[str] = TARGET_CANDIDATES) -> str | None:
    """The first candidate both tables have, in the original's spelling."""
    return next((find_column(original, c) for c in candidates if find_column(original, c) and find_column(synthetic, c)), None)


def _small_forest(train: DataFrame, test: DataFrame, trees: int, max_depth: int) -> DataFrame:
    # The node of every row is kept instead of found from the root at each level, with its lineage cut every ten levels.
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=42, cacheNodeIds=True, checkpointInterval=10)
    return forest.fit(train).transform(test).withColumn("rows", F.lit(1))


def _regression(train: DataFrame) -> LogisticRegression:
    # An L2 penalty of weight 1 on the summed loss is 1/n on the mean loss.
    return LogisticRegression(maxIter=1000, regParam=1.0 / max(train.count(), 1), standardization=False, tol=1e-4)


def _prepared(df: DataFrame, key: str, features: Sequence[str], target: str, codes: DataFrame, seed: int) -> DataFrame:
    """(features, label, is_test): nulls become 0, labels use the original's codes."""
    values = [F.coalesce(F.col(find_column(df, c)).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(features)]
    rows = df.select(F.col(find_column(df, key)).alias("_key"), F.col(find_column(df, target)).alias(target), *values)
    labelled = apply_encoder(rows, codes).dropna(subset=[target])
    vectors = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="features").transform(labelled)
    split = holdout_split(vectors, "_key", seed=seed)
    return split.select("features", F.col(target).cast("double").alias("label"), "is_test")


def _score(scored: DataFrame, raw: str, binary: bool) -> tuple[float | None, float | None]:
    """Accuracy and AUC over (label, prediction, ``raw``) that stand for ``rows`` rows each."""
    right = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(0))
    accuracy = scored.agg(F.try_divide(right, F.sum("rows"))).first()[0]
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC", rawPredictionCol=raw, weightCol="rows")
    return accuracy, evaluator.evaluate(scored) if binary else None


def model_utility(
    original: DataFrame,
    synthetic: DataFrame,
    key: str,
    target: str | None = None,
    features: Sequence[str] | None = None,
    models: Sequence[str] = MODELS,
    trees: int = 100,
    max_depth: int = MAX_DEPTH,
    seed: int = 42,
    small_rows: int = SMALL_ROWS,
) -> DataFrame:
    """One row per model: accuracy and AUC of the original's and the synthetic table's model.

    Features are the columns numeric in both tables. No rows without a target or a feature. Up to ``small_rows`` rows to learn
    from on both sides, the random forest is Spark's; from more it is grown in parts, with other random numbers.
    """
    spark = original.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(durable_dir(spark))
    if unknown := [m for m in models if m not in MODELS]:
        raise ValueError(f"model must be one of {', '.join(MODELS)}, not {', '.join(unknown)}")
    target = target or pick_target(original, synthetic)
    if target is None:
        return spark.createDataFrame([], RESULT_SCHEMA)
    name = find_column(original, target)
    features = [c for c in common_numeric(original, synthetic, features) if c != name]
    if not features:
        return spark.createDataFrame([], RESULT_SCHEMA)
    codes = materialise(fit_encoder(original.select(name), [name]), "labels")
    classes = codes.count()
    binary = classes == 2

    prepared = [
        _prepared(df, key, features, name, codes, seed).persist(StorageLevel.MEMORY_AND_DISK) for df in (original, synthetic)
    ]
    try:
        test = prepared[0].filter("is_test")
        small = "random_forest" in models and all(rows.filter(~F.col("is_test")).count() <= small_rows for rows in prepared)
        results = []
        for model in models:
            scores = []
            for rows in prepared:
                train = rows.filter(~F.col("is_test"))
                if model == "random_forest" and small:
                    scores.append(_score(_small_forest(train, test, trees, max_depth), "rawPrediction", binary))
                elif model == "random_forest":
                    scored = forest_scores(train, test, len(features), classes, trees, max_depth)
                    scores.append(_score(materialise(scored, "scores"), "score", binary))
                else:
                    scored = _regression(train).fit(train).transform(test).withColumn("rows", F.lit(1))
                    scores.append(_score(scored, "rawPrediction", binary))
            (acc_o, auc_o), (acc_s, auc_s) = scores
            gap = acc_s - acc_o if acc_o is not None and acc_s is not None else None
            results.append((model, name, acc_o, acc_s, gap, auc_o, auc_s, gap is not None and abs(gap) < PRESERVED_GAP))
    finally:
        for rows in prepared:
            rows.unpersist()
    return spark.createDataFrame(results, RESULT_SCHEMA)
