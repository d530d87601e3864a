"""Session defaults and the durable scratch space shared by the executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from veilframe.sources.files import remove

_SCOPE: ContextVar[list[str] | None] = ContextVar("veilframe_scope", default=None)


def build_session(app_name: str = "veilframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def durable_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master; on a cluster a missing setting is an
    error, because other executors could not read what one of them wrote.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="veilframe-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; inside ``run_scope`` what is stored there goes with the scope."""
    path = f"{durable_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (held := _SCOPE.get()) is not None:
        held.append(path)
    return path


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end or after a failure, all intermediate tables that are stored inside.

    Only for work that writes its results elsewhere: a DataFrame made inside may still read them. Scopes nest, each one takes
    its own; threads started inside do not belong to it.
    """
    token = _SCOPE.set([])
    try:
        yield
    finally:
        held = _SCOPE.get()
        _SCOPE.reset(token)
        for path in held:
            remove(spark, path)


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go as soon as it ends, instead of when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """Write once, read back: cuts lineage, survives lost executors, keeps column pruning. ``tidy``: see ``tidy_shuffles``."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with tidy_shuffles(spark) if tidy else nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_bucketed(df: DataFrame, label: str, column: str, buckets: int) -> DataFrame:
    """The same, in hash buckets of a column: grouping and windows by it (and more) need no exchange."""
    spark, plain = df.sparkSession, [f"c{i}" for i in range(len(df.columns))]  # names that any catalog takes
    name = f"veilframe_{label}_{uuid.uuid4().hex}"
    key = plain[df.columns.index(column)]
    writer = df.toDF(*plain).write.format("parquet").bucketBy(buckets, key)
    writer.option("path", scratch_path(spark, label)).saveAsTable(name)
    stored = spark.table(name).toDF(*df.columns)
    spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay, and the plan knows them
    return stored
