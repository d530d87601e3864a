"""Ingest files dropped into a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from veilframe.operators.privacy import report_of_profile, value_profile
from veilframe.operators.pseudonyms import mask_columns, pseudonymise_id, pseudonymise_table
from veilframe.schema import PERSON_SCHEMA, QUASI_IDENTIFIERS, SENSITIVE, present, require
from veilframe.session import materialise, run_scope
from veilframe.sources.files import names_in
from veilframe.sources.report import read_report, write_report
from veilframe.sources.tables import normalise_missing
from veilframe.streaming.profile_state import ProfileState


def _dropped(spark: SparkSession, path: str, schema: T.StructType, max_files: int, multi_line: bool) -> DataFrame:
    files = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", max_files)
    )
    return normalise_missing(files.csv(path))


def ingest_dropfolder(
    spark: SparkSession,
    path: str,
    output: str,
    checkpoint: str,
    schema: T.StructType = PERSON_SCHEMA,
    mode: str = "keyed",
    mapping_path: str | None = None,
    secret: str = "",
    salt: str = "",
    max_files: int = 1_000,
    multi_line: bool = True,
    report: str | None = None,
    qi: Sequence[str] = QUASI_IDENTIFIERS,
    sensitive: Sequence[str] = SENSITIVE,
) -> StreamingQuery:
    """Pseudonymise every new CSV file once and append it as parquet.

    Keyed ids and all masks are stateless projections that run on the stream itself. Random ids extend
    the mapping per micro-batch; a batch goes to a folder of its own number and is overwritten when it is
    repeated, and ids mapped by a failed attempt are simply known in the next one.

    With ``report``, a folder, every micro-batch is followed by the privacy report on everything ingested so far
    (``latest_report`` reads it). Only the batch is counted; its counts are merged into those kept below ``report/state``.
    """
    people = _dropped(spark, path, schema, max_files, multi_line)
    if mode not in ("keyed", "random"):
        raise ValueError("mode must be 'random' or 'keyed'")
    if mode == "random" and not mapping_path:
        raise ValueError("random pseudonyms need a mapping_path")
    if mode == "keyed" and report is None:
        masked = pseudonymise_id(mask_columns(people, salt), mode="keyed", secret=secret)
        writer = masked.writeStream.format("parquet").option("path", output).outputMode("append")
    else:

        def write_batch(batch: DataFrame, number: int) -> None:
            # Read the files once: the mapping and the join below both need the batch.
            people = batch.persist(StorageLevel.MEMORY_AND_DISK) if mode == "random" else batch
            try:
                with run_scope(batch.sparkSession):
                    done = pseudonymise_table(people, mapping_path, mode=mode, secret=secret, salt=salt)
                    done.write.mode("overwrite").parquet(f"{output}/batch={number}")
            finally:
                if mode == "random":
                    people.unpersist()
            if report is not None:
                stored = batch.sparkSession.read.schema(done.schema).parquet(f"{output}/batch={number}")
                report_batch(stored, number, report, qi, sensitive)

        writer = people.writeStream.foreachBatch(write_batch)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def report_batch(batch: DataFrame, number: int, report: str, qi: Sequence[str], sensitive: Sequence[str]) -> None:
    """Merge the counts of a batch into those of the earlier ones and write the report on all; a repeated batch counts once."""
    spark = batch.sparkSession
    qi, sensitive = require(batch, present(batch, qi)), present(batch, sensitive)
    if not qi or not sensitive:
        raise ValueError("a report on arrival needs a quasi-identifier and a sensitive column")
    state = ProfileState(spark, f"{report}/state", qi)
    with run_scope(spark):
        state.add(value_profile(batch, qi, sensitive), number)
        profile = materialise(state.upto(number), "profile")
        rows = report_of_profile(profile, qi, sensitive).select(F.lit("stream").alias("dataset"), "*")
        write_report(rows, f"{report}/reports/{number:012d}", mode="overwrite")


def latest_report(spark: SparkSession, report: str) -> DataFrame | None:
    """The report after the newest batch; None before the first."""
    done = names_in(spark, f"{report}/reports")
    return read_report(spark, f"{report}/reports/{done[-1]}") if done else None
