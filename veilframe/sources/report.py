"""The metrics report as JSON rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import materialise

METRICS_SCHEMA = (
    "dataset string, family string, metric string, param string, field string, value_num double, value_str string"
)


def write_report(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``path/json``: one object per metric value; ``path/text``: one readable line each. The plan runs once."""
    metrics = materialise(metrics, "metrics")
    metrics.write.mode(mode).json(f"{path}/json")
    report_lines(metrics).write.mode(mode).text(f"{path}/text")


def report_lines(metrics: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("value_str"), F.col("value_num").cast("string"))
    name = F.concat_ws(".", "dataset", "family", "metric", "param", "field")
    return metrics.select(F.concat(name, F.lit(": "), F.coalesce(value, F.lit("n/a"))).alias("value"))


def read_report(spark, path: str) -> DataFrame:
    return spark.read.schema(METRICS_SCHEMA).json(f"{path}/json")
