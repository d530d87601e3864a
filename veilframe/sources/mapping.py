"""The pseudonym mapping: a key-value store in hash buckets of the id, for several writers.

Below ``path`` every namespace has a folder with ``data`` and ``commits``. A writer puts new rows into a data folder of its own,
one file for each hash bucket of the id, and then publishes the next commit: a small file whose name is the next number and whose
content lists all data folders. Only one writer can take a number, so the first commit wins; who comes second finds its rows
unpublished, reads the winner's and tries again with what is still unknown. A reader sees the folders of one commit.

Spark reads a commit as a bucketed table, so that a lookup of few ids opens the files of their buckets only, and a join with many
ids shuffles those ids alone. When a namespace has more than ``FOLDERS`` data folders, they are rewritten into one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.sources.files import names_in, publish, read_text, remove

MAPPING_SCHEMA = "original string, pseudonym string, namespace string"
#: Hash buckets of a new namespace; one for some ten million ids.
BUCKETS = 64
#: Data folders of a namespace before they are rewritten into one.
FOLDERS = 16
#: Ids that are looked up by value; more are joined.
FEW_IDS = 10_000


@dataclass(frozen=True)
class Commit:
    """What one commit of a namespace holds; version 0 is a namespace nobody has written yet."""

    path: str
    namespace: str
    version: int
    buckets: int
    folders: tuple[str, ...]


def _home(path: str, namespace: str) -> str:
    return f"{path.rstrip('/')}/namespace={quote(namespace, safe='')}"


def latest(spark: SparkSession, path: str, namespace: str, buckets: int = BUCKETS) -> Commit:
    home = _home(path, namespace)
    taken = [n for n in names_in(spark, f"{home}/commits") if n.isdigit()]
    if not taken:
        return Commit(path, namespace, 0, buckets, ())
    content = json.loads(read_text(spark, f"{home}/commits/{taken[-1]}"))
    return Commit(path, namespace, int(taken[-1]), content["buckets"], tuple(content["folders"]))


def _follow(spark: SparkSession, commit: Commit, folders: tuple[str, ...]) -> bool:
    """Publish the commit after ``commit``; False if another writer has published one."""
    content = json.dumps({"buckets": commit.buckets, "folders": list(folders)})
    return publish(spark, f"{_home(commit.path, commit.namespace)}/commits/{commit.version + 1:020d}", content)


def _store(commit: Commit, rows: DataFrame) -> str:
    """Rows as a new data folder, one file for each bucket; nobody sees it before a commit names it."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    table = f"veilframe_new_{name}"
    writer = rows.select("original", "pseudonym").repartition(commit.buckets, "original").write.format("parquet")
    writer.bucketBy(commit.buckets, "original").sortBy("original").option("path", f"{_home(commit.path, commit.namespace)}/data/{name}").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the table is external: its files stay
    return name


def table_of(spark: SparkSession, commit: Commit) -> DataFrame:
    """original, pseudonym and namespace of a commit, as a table that Spark knows to be bucketed by the id."""
    home = _home(commit.path, commit.namespace)
    key = hashlib.sha256(f"{home}\0{commit.version}".encode()).hexdigest()[:24]
    table = f"veilframe_mapping_{key}"
    place = lambda folder: f"{home}/data/{folder}".replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} (original string, pseudonym string, folder string) USING parquet PARTITIONED BY (folder) "
        f"CLUSTERED BY (original) SORTED BY (original) INTO {commit.buckets} BUCKETS LOCATION '{place('')}'"
    )
    if commit.folders:
        parts = " ".join(f"PARTITION (folder = '{f}') LOCATION '{place(f)}'" for f in commit.folders)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
    return spark.table(table).select("original", "pseudonym", F.lit(commit.namespace).alias("namespace"))


def load_mapping(spark: SparkSession, path: str, namespace: str | None = None) -> DataFrame | None:
    """The mapping of one namespace or of all, or None where nothing has been stored yet."""
    names = [namespace] if namespace is not None else [unquote(n.removeprefix("namespace=")) for n in names_in(spark, path) if n.startswith("namespace=")]
    commits = [c for c in (latest(spark, path, n) for n in names) if c.version]
    return reduce(DataFrame.unionByName, [table_of(spark, c) for c in commits]) if commits else None


def add_rows(
    spark: SparkSession, path: str, namespace: str, missing: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS
) -> Commit:
    """Publish the (original, pseudonym) rows that ``missing`` makes out of the mapping so far; returns the commit that holds them.

    When another writer publishes first, what this one has stored is dropped and ``missing`` is asked again, so that it has to
    leave out what the mapping holds by then. Rows are stored before anyone reads them: a recomputed ``uuid()`` would differ.
    """
    while True:
        commit = latest(spark, path, namespace, buckets)
        folder = _store(commit, missing(table_of(spark, commit)))
        stored = f"{_home(path, namespace)}/data/{folder}"
        if not any(n.startswith("part-") for n in names_in(spark, stored)):  # no row was missing
            remove(spark, stored)
            if commit.version or _follow(spark, commit, ()):
                return latest(spark, path, namespace) if not commit.version else commit
            continue
        if _follow(spark, commit, (*commit.folders, folder)):
            done = Commit(path, namespace, commit.version + 1, commit.buckets, (*commit.folders, folder))
            return compact(spark, done) if len(done.folders) > FOLDERS else done
        remove(spark, stored)


def compact(spark: SparkSession, commit: Commit) -> Commit:
    """All folders of a commit as one; folders that others add meanwhile stay beside it. Readers of the old ones lose nothing.

    Returns the newest commit. If another writer has compacted meanwhile, this one's work is dropped.
    """
    folder = _store(commit, table_of(spark, commit))
    while True:
        now = latest(spark, commit.path, commit.namespace)
        if not set(commit.folders) <= set(now.folders):
            remove(spark, f"{_home(commit.path, commit.namespace)}/data/{folder}")
            return now
        folders = (folder, *(f for f in now.folders if f not in commit.folders))
        if _follow(spark, now, folders):
            return Commit(now.path, now.namespace, now.version + 1, now.buckets, folders)


def compact_mapping(spark: SparkSession, path: str, namespace: str = "person") -> DataFrame:
    """One file for each bucket of a namespace; every id keeps its pseudonym."""
    return table_of(spark, compact(spark, latest(spark, path, namespace)))


def drop_unused(spark: SparkSession, path: str, namespace: str = "person") -> list[str]:
    """Delete data folders that the newest commit does not name; only while nobody writes or reads older commits."""
    home, named = _home(path, namespace), latest(spark, path, namespace).folders
    unused = [n for n in names_in(spark, f"{home}/data") if n not in named]
    for n in unused:
        remove(spark, f"{home}/data/{n}")
    return unused
