"""A uniform shuffle of rows into shards of exact sizes, by a hypergeometric communication matrix.

How many rows of each block go to each shard is drawn first, exactly as a uniform permutation of all rows would deal them:
for groups of blocks in the driver, then for the blocks of each group in a task of its own.
Then a block permutes its rows and cuts them at those counts, shards exchange, and each shard's rows are permuted again. A
block is a run of at most ``BLOCK_ROWS`` rows of one input partition, stored with its rows, so that a lost task deals the
same cards again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import pick
from veilframe.operators.ordered import with_row_index
from veilframe.session import materialise

BLOCK_ROWS = 1 << 20
GROUP_PARTITIONS = 64  # input partitions whose blocks are drawn by one task


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """How many of ``draws`` rows without replacement are good, by inversion at ``u``; any population size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    share = good / (good + bad)
    spread = 12 * np.sqrt(draws * share * (1 - share)) + 30
    mode = (draws + 1) * (good + 1) // (good + bad + 2)
    low, high = max(low, int(mode - spread)), min(high, int(mode + spread))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    total = np.cumsum(np.exp(weight - weight.max()))
    return low + int(min(np.searchsorted(total, u * total[-1], "right"), high - low))


def communication_matrix(blocks: list[int], shards: list[int], seed: int | list[int]) -> np.ndarray:
    """Rows from each block to each shard; row sums are ``blocks``, column sums ``shards``."""
    rng = np.random.default_rng(seed)
    left, out = list(shards), np.zeros((len(blocks), len(shards)), np.int64)
    for i, rows in enumerate(blocks):
        rest = sum(left)
        for j, room in enumerate(left):
            rest -= room
            got = hypergeometric(room, rest, rows, rng.random())
            out[i, j] = got
            left[j] -= got
            rows -= got
    return out


def group_matrix(blocks: list[int], room: list[int], seed: int, group: int) -> np.ndarray:
    """The matrix of one group's blocks, whose shares of the shards are drawn already."""
    return communication_matrix(blocks, room, [seed, group + 1])  # a zero at the end would repeat the draws of ``seed`` alone


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, seed: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Law ``rows``: shards differ by one row at most, the first ones are the longer. Slots number a shard's rows from 0 without
    gaps. A null text counts no bytes. Null ids, rows that repeat and equal texts are rows like any other: every row has the
    same chance for every place. Other columns play no part. An empty table gives an empty result.
    """
    text = F.col("text")
    placed = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    in_partition = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    stored = materialise(placed.withColumn("_block", F.shiftleft(F.spark_partition_id().cast("long"), 13) + F.floor(in_partition / BLOCK_ROWS)), "rows")

    counts = stored.groupBy("_block").agg(F.count("*").alias("_rows")).withColumn("_group", F.floor(F.col("_block") / (GROUP_PARTITIONS << 13)))
    groups = sorted(map(tuple, counts.groupBy("_group").agg(F.sum("_rows")).collect()))  # a row for 64 partitions
    total = sum(c for _, c in groups)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([c for _, c in groups], sizes, seed)
    rooms = stored.sparkSession.createDataFrame([(group, row) for (group, _), row in zip(groups, matrix.tolist())], "_group long, _room array<long>")

    def draw(group: pa.Table) -> pa.Table:
        group = group.sort_by("_block")
        number, room = group["_group"][0].as_py(), group["_room"][0].as_py()
        rows = group_matrix(group["_rows"].to_pylist(), room, seed, number)
        return pa.table({"_block": group["_block"], "_cuts": pa.array(np.cumsum(rows, axis=1).tolist(), pa.list_(pa.int64()))})

    cuts = counts.join(rooms, "_group").groupBy("_group").applyInArrow(draw, "_block long, _cuts array<long>")
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed), "_row"), "_row")
    dealt = (
        stored.withColumn("_rank", F.row_number().over(local) - 1)
        .join(cuts, "_block")
        .withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("int"))
        .withColumn("_key", F.xxhash64(F.lit(seed + 1), "_row"))
        .select("doc_id", "size", "text_crc32", "shard", "_key", "_row")
    )
    starts = F.array(*[F.lit(int(s)) for s in np.cumsum([0, *sizes[:-1]])])
    return with_row_index(dealt, ["shard", "_key", "_row"], "_index").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("_index") - F.element_at(starts, F.col("shard") + 1)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
