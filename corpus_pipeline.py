"""The corpus pipeline: five stages from raw documents to packed sequences, each one an operator of ``veilframe.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's rows as Parquet and reads them again, so that a lost executor never costs more than one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, lines, near_dedup, packing, quality
from veilframe.session import materialise


#: Of a hundred, the shingles that two documents of the pipeline share as near-duplicates; op 4's query has 85 by its own contract.
NEAR_PERCENT = 80


def _named(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join by what names a row between the scans of a stage: its id (null-safe) and a hash of its text."""
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), how)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; the score depends on the text alone.

    So rows that repeat go or stay together; null and empty texts have a score like any other. An empty table gives an empty one.
    """
    scorer = quality.fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, scorer)


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; n_chars follows the text. No document goes."""
    cleaned = lines.without_lines(docs, lines.similar_lines(docs))
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the smallest id (null last), of these of the smallest text hash.

    Ids may be null or repeat: a group keeps one row all the same, and one of rows that repeat. Rows without words (null, empty,
    white space) are near nothing and all stay. An empty table gives an empty one.
    """
    found = near_dedup.near_duplicates(docs, percent=NEAR_PERCENT)
    kept = _named(docs, found.where("chosen"), "left_semi").withColumn("_hash", F.xxhash64("text"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.withColumn("_row", F.when(wordless, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
    return kept.dropDuplicates(["doc_id", "_hash", "_row"]).drop("_hash", "_row")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows of one id and text go or stay together."""
    return _named(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed best-fit into sequences of at most 1024 tokens.

    A null or empty text is its end token alone; each row that repeats has pieces of its own. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_similar_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: The classifier, the tiling and the token ids are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
