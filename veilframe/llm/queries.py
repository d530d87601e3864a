"""The queries of the subpackage: each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import ann, class_lm, decontaminate, lines, near_dedup, packing, pii, prefix_trie, quality, runs, sharding, sql, substrings


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def op1_block_join(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(_read(spark, sf, "embeddings"))


def op2_string_tiling(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf, "documents"), _read(spark, sf, "benchmark")).drop("text_hash")


def op3_boosted_trees(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(_read(spark, sf, "documents"), _read(spark, sf, "labels"))


def op4_setsketch(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf, "documents")).drop("text_hash", "chosen")


def op5_hypergeometric(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(_read(spark, sf, "documents"))


def op6_lstm_crf(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(_read(spark, sf, "documents"))


def op7_length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return packing.context_totals(packing.length_histogram(_read(spark, sf, "documents")))


def op8_gear_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeated_spans(_read(spark, sf, "documents"))


def op9_set_join(spark: SparkSession, sf: str) -> DataFrame:
    return lines.similar_lines(_read(spark, sf, "documents"))


def op10_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_read(spark, sf, "documents"))


def crc_of(column: str) -> Column:
    """The unsigned CRC-32 of a number written in decimal; null for null."""
    return F.crc32(F.col(column).cast("long").cast("string").cast("binary"))


def repeat_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of a tenth of the documents repeat periodically from some word on.

    With h the CRC of the id and n words, h % 10 = 0 and n > 0: each word i >= a becomes word a + (i - a) % p.
    """
    h = crc_of("doc_id")
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1).cast("int")
    head, tail = F.slice(words, F.lit(1), a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(head, F.slice(tail, F.lit(1), n - a)), " ")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when((F.pmod(h, F.lit(10)) == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), repeated).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from the runs and collapsed texts of ``periodic_runs``."""
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = found.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), longer))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_square_catcher(spark: SparkSession, sf: str) -> DataFrame:
    return run_digests(runs.periodic_runs(repeat_tails(_read(spark, sf, "documents"))))


def op12_brown_classes(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    held_out = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(5)) == 1, F.lit(False))
    return class_lm.score(docs, class_lm.fit(docs.where(~held_out))).withColumn("held_out", held_out)


def borrowed_starts(sequences: DataFrame, most: int = 8) -> DataFrame:
    """Every conversation c with its first h = CRC(c) % 9 turns taken from conversation c - c % 5, none where that is absent."""
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(5)), F.pmod(crc_of("conv_id"), F.lit(most + 1)).cast("int")
    heads = sequences.where(F.pmod("conv_id", F.lit(5)) == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head"))
    both = sequences.withColumns({"_base": base, "_h": h}).join(heads, "_base", "left")
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return both.select("conv_id", F.when(F.col("_head").isNull(), own).otherwise(F.concat(F.slice("_head", F.lit(1), F.col("_h")), own)).alias("turns"))


def trie_digests(paths: DataFrame) -> DataFrame:
    """The columns of the contract: the nodes of the trie, and the digest of the ids that end in each."""
    nodes = prefix_trie.prefix_trie(paths).drop("parent_hi", "parent_lo").join(prefix_trie.ends_digests(paths), ["hi", "lo"], "left")
    return nodes.drop("hi", "lo").fillna({"ends_sha256": prefix_trie.NO_ENDS})


def op13_hash_trie(spark: SparkSession, sf: str) -> DataFrame:
    return trie_digests(prefix_trie.prefix_paths(borrowed_starts(prefix_trie.turn_sequences(_read(spark, sf, "conversations")))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_join": op1_block_join,
    "op2_string_tiling": op2_string_tiling,
    "op3_boosted_trees": op3_boosted_trees,
    "op4_setsketch": op4_setsketch,
    "op5_hypergeometric": op5_hypergeometric,
    "op6_lstm_crf": op6_lstm_crf,
    "op7_length_histogram": op7_length_histogram,
    "op8_gear_chunks": op8_gear_chunks,
    "op9_set_join": op9_set_join,
    "op10_best_fit": op10_best_fit,
    "op11_square_catcher": op11_square_catcher,
    "op12_brown_classes": op12_brown_classes,
    "op13_hash_trie": op13_hash_trie,
}

ORACLES: dict[str, str] = {
    "op1_block_join": sql.NEAREST,
    "op4_setsketch": sql.NEAR,
}
