"""Large CSV files whose quoted cells hold newlines, read by many tasks.

Files are cut into splits at any newline. Whether a line begins inside a quoted cell follows from the number of quotes before it in
its file: splits are counted first, prefix sums over the splits give where each one starts, and a running sum the same for its
lines. Lines of one record are put together inside their split; what crosses the end of a split, at most two pieces for each, is
put together afterwards. Spark's own parser then reads the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = '"'


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether the record begins the file) and record, the text of every CSV record without its line end.

    Lines end with a newline, after a carriage return or not (a last record without a line end keeps its carriage returns). Quotes have to be balanced, with doubled ones inside quoted cells.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value"
    )
    lines = lines.withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))) % 2)
    by_split = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each split.
    starts = lines.groupBy("file", "split").agg(F.sum("odd").alias("odds"))
    starts = starts.select("file", "split", F.coalesce(F.sum("odds").over(by_split), F.lit(0)).alias("before"))

    inside = Window.partitionBy("file", "split").orderBy("line")
    earlier, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.join(starts, ["file", "split"]).withColumn("quoted", (F.col("before") + F.coalesce(F.sum("odd").over(earlier), F.lit(0))) % 2)
    # Record 0 of a split is what goes on from the one before.
    numbered = placed.withColumn("record", F.sum((F.col("quoted") == 0).cast("int")).over(upto))
    joined = numbered.groupBy("file", "split", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.col("value").alias("text")))), lambda x: x["text"]), "\n").alias("text"),
        ((F.max_by("quoted", "line") + F.max_by("odd", "line")) % 2 == 1).alias("open"),
    )
    loose = F.col("open") | (F.col("record") == 0)
    whole = joined.where(~loose).select("file", "split", "record", "text")
    along = Window.partitionBy("file").orderBy("split", "record").rowsBetween(Window.unboundedPreceding, 0)
    pieces = joined.where(loose).withColumn("begun", F.sum((F.col("record") > 0).cast("int")).over(along))
    mended = pieces.groupBy("file", "begun").agg(F.array_sort(F.collect_list(F.struct("split", "record", "text"))).alias("all"))
    mended = mended.select("file", F.col("all")[0]["split"].alias("split"), F.col("all")[0]["record"].alias("record"), F.array_join("all.text", "\n").alias("text"))
    # Where records end with a carriage return and a newline, Spark's reader takes that pair for a newline inside cells, too.
    text = F.when(F.endswith("text", F.lit("\r")), F.replace(F.regexp_replace("text", r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("text"))
    first = (F.col("split") == 0) & (F.col("record") == 1)
    return whole.unionByName(mended).select("file", first.alias("first"), text.alias("record")).where("first OR trim(record) <> ''")


def read_split_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same table as Spark's reader gives with ``multiLine``, header and ``escape`` of a quote, in no particular order.

    Every file has the header of the schema; another one is an error.
    """
    options = {"escape": QUOTE}
    names = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    found = records(spark, path)
    wanted = [f.name.lower() for f in schema.fields]
    heads = found.where("first").select(F.from_csv("record", _ddl(names), options).alias("h")).distinct().limit(2).collect()
    for head in heads:
        if [str(v or "").strip().lower() for v in head["h"]] != wanted:
            raise ValueError(f"the header {list(head['h'])} is not {wanted}")
    return found.where("NOT first").select(F.from_csv("record", _ddl(schema), options).alias("r")).select("r.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file, without reading any."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.max("length"), F.lit(0))).first()[0]
