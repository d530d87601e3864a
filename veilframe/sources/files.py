"""Small files of a store, by the Hadoop file system that Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none where there is no folder."""
    where, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _path(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file under a name that must be new; False if someone else was first.

    The file is written beside its place and then given its name in one step that fails if the name is taken: a hard link on a
    local disk, elsewhere a rename without overwriting, which has to be atomic there, as on HDFS.
    """
    jvm = spark._jvm
    where, fs = _path(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark._sc._gateway.new_array(jvm.java.lang.String, 0)) for p in (where, beside)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            keep = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, where, keep)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(beside, False)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    where, fs = _path(spark, path)
    fs.delete(where, True)
