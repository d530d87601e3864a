"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text: shifted left by two bits and added a random number for each byte, it depends on
the last 16 bytes. A chunk ends where the hash's upper bits are zero, so that chunks of a repeated passage are the same
whatever was inserted before it. Chunks are deduplicated by digest: the document that comes first keeps a chunk, later
documents repeat it, and neighbouring repeated chunks are one run. A passage seldom begins and ends with a chunk, so a run
grows byte by byte on both sides as far as the earlier document goes on with the same bytes.

Digests are counted first, and only chunks whose digest may occur twice are shuffled with their places; a bit set of fixed
size tells which, and the exact join decides. Of the texts, only the bytes around the ends of runs are shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import BYTE_CODES, GOLDEN, SPACE, U64, arrow_map, may_hold, membership, mixed, pick, slices, span_hashes, words
from veilframe.operators.lookup import HEAVY_LIMIT, spread_join
from veilframe.session import materialise

REACH = 16  # bytes that the hash depends on
SHORTEST, LONGEST = 16, 128
ZERO_BITS = 4
LEAST_WORDS = 50
SEED_PART = 5  # a run grows if its chunks hold a fifth of the words wanted; a passage of 50 words leaves 15 or more
BEFORE, AFTER = 2 * LONGEST, LONGEST + 1  # bytes around the ends of runs; a chunk cut alike ends within LONGEST bytes
_GEAR = (BYTE_CODES >> U64(32)).astype(np.uint32)
_OTHER_CODES = mixed(BYTE_CODES)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, by doubling the reach of partial sums."""
    total, reach = _GEAR[data], 1
    while reach < REACH:
        longer = total.copy()
        longer[reach:] += total[:-reach] << np.uint32(2 * reach) if len(total) > reach else 0
        total, reach = longer, 2 * reach
    return total


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the chunks and how many each text has. No end is looked for before the hash has left the text before."""
    spots = np.flatnonzero(gear(data) >> np.uint32(32 - ZERO_BITS) == 0)
    spot_list, after = spots.tolist(), np.searchsorted(spots, spots + SHORTEST).tolist()
    first = np.searchsorted(spots, offsets[:-1] + SHORTEST - 1).tolist()
    ends, counts, known = [], [], len(spot_list)
    for at, stop, k in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first):
        before = len(ends)
        while at < stop:
            if k < known and spot_list[k] < min(at + LONGEST, stop):
                at, k = spot_list[k] + 1, after[k]
            elif at + LONGEST < stop:
                at += LONGEST
                k = bisect_left(spot_list, at + SHORTEST - 1)
            else:
                at = stop
            ends.append(at)
        counts.append(len(ends) - before)
    return np.array(ends, np.int64), np.array(counts, np.int64)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts and digests of the chunks."""
    ends, counts = chunk_ends(data, offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    return starts, ends, owner, span_hashes(BYTE_CODES[data], starts, ends)


def spot_keys(text_hash: np.ndarray, spot: np.ndarray, side: np.ndarray | int) -> np.ndarray:
    """A 64-bit key of a place in a text and the side of it that is looked at (0 before, 1 after)."""
    return mixed(text_hash.astype(np.int64).view(U64) + mixed((2 * spot + side).astype(U64) * U64(GOLDEN)))


def edges(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """of, spot, side, edge: the bytes before (nearest first) or from one byte before on, at the places that ``asked`` names.

    Places are starts and ends of chunks; a bit set of fixed size tells which are asked for, the join with ``asked`` decides.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, spot, side = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(spot_keys(of, spot, side).view(np.int64))], ["key"])

    held = membership(arrow_map(asked.select("of", "spot", "side"), keys, "key long"), "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            ends, counts = chunk_ends(data, offsets)
            owner = np.repeat(np.arange(len(counts)), counts)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
            hashes, base, stop = rows.column(0).to_numpy()[owner], offsets[owner], offsets[owner + 1]
            raw = data.tobytes()
            for side, spots in enumerate((starts, ends)):
                take = np.flatnonzero(may_hold(held.value, spot_keys(hashes, spots - base, side)))
                if side:
                    found = [raw[s - 1 : min(e, s - 1 + AFTER)] for s, e in zip(spots[take].tolist(), stop[take].tolist())]
                else:
                    found = [raw[max(b, s - BEFORE) : s][::-1] for s, b in zip(spots[take].tolist(), base[take].tolist())]
                columns = [hashes[take], (spots - base)[take], np.full(len(take), side, np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(found, pa.binary())], ["of", "spot", "side", "edge"])

    # Copies of a text give the same edges, which meet in the map side of the aggregate.
    return arrow_map(docs.select("text_hash", "text"), cut, "of long, spot long, side int, edge binary").distinct()


def growth(own: list[bytes | None], other: list[bytes | None], within: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of edges the number of bytes that agree beyond the run, and of the words that begin in them.

    The run goes on for ``within`` bytes beyond the place of the edges, in chunks of other sources.
    """
    width, n = (AFTER if side else BEFORE), len(own)
    left, right = (
        np.frombuffer(b"".join((x or b"").ljust(width, b" ") for x in edge), np.uint8).reshape(n, width) for edge in (own, other)
    )
    sizes = [np.array([len(x or b"") for x in edge], np.int64) for edge in (own, other)]
    spot = np.arange(width)
    same = (left == right) & (spot < np.minimum(*sizes)[:, None])
    length = np.where(same.all(1), width, same.argmin(1))
    space = SPACE[left]
    begun = ~space
    if side:  # the first byte is the one before the place
        begun[:, 0] = False
        begun[:, 1:] &= space[:, :-1]
        within = within + 1
    else:
        length = np.minimum(length, width - 1)  # whether a word begins with the last byte is not known
        begun[:, :-1] &= space[:, 1:]  # before the text's start there are spaces
    beyond = (spot >= within[:, None]) & (spot < length[:, None])
    return np.maximum(length - within, 0), (begun & beyond).sum(1)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, span_start, span_end (bytes), n_chunks, n_words, source_doc_id: spans that earlier documents have as well.

    Documents are in the order of id (null last) and text hash; what a document repeats of itself does not count. A run of
    repeated chunks has as its source the document that is the first to have most of them, at one distance (ties: the first
    document). Beyond the first and the last chunk that are the source's, the run grows while its document and its source agree,
    by fewer than ``BEFORE`` and ``AFTER`` bytes, which is as far as chunks of prose that are cut differently reach. A span is a grown run in which
    ``least_words`` words or more begin; runs whose chunks hold less than a fifth of them are not grown. Chunks within a run
    may come from other earlier documents than the source. Null and empty texts have no chunks. Rows that repeat a whole row
    are one document. Other columns play no part. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_chunks(data, offsets)[3].view(np.int64))], ["d1"])

    often = arrow_map(docs.select("text"), digests, "d1 long").groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1")
    held = membership(often, "d1")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            starts, ends, owner, d1 = _chunks(data, offsets)
            take = np.flatnonzero(may_hold(held.value, d1))
            if not len(take):
                continue
            d2 = span_hashes(_OTHER_CODES[data], starts[take], ends[take])
            begins, _, _ = words(data, offsets)
            begun = np.searchsorted(begins, ends[take]) - np.searchsorted(begins, starts[take])
            of, base = pa.array(owner[take]), offsets[owner[take]]
            number = take - np.searchsorted(owner, owner[take])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(of),
                    rows.column(1).take(of),
                    *[pa.array(x) for x in (number, starts[take] - base, ends[take] - base, begun, d1[take].view(np.int64), d2.view(np.int64))],
                ],
                ["doc_id", "text_hash", "number", "start", "end", "begun", "d1", "d2"],
            )

    schema = "doc_id long, text_hash long, number long, start long, end long, begun long, d1 long, d2 long"
    found = materialise(arrow_map(docs, places, schema), "chunks")
    document = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "start")
    owners = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(document).alias("last"), F.count("*").alias("places"))
    source = F.struct("first.null_id", "first.doc_id", "first.text_hash")
    owners = owners.where(source < F.col("last")).drop("last")
    # A chunk may be in a third of all documents: the most frequent ones come by broadcast, their places spread over the shuffle.
    often = owners.orderBy(F.desc("places"), "d1", "d2").limit(HEAVY_LIMIT)
    repeats = spread_join(found, owners, often, ["d1", "d2"], ["first"], ["text_hash", "number"]).where(F.col("first").isNotNull() & (source < document))
    repeats = repeats.select("doc_id", "text_hash", "number", "start", "end", "begun", source.alias("source"), (F.col("first.start") - F.col("start")).alias("shift"))
    in_text = Window.partitionBy("doc_id", "text_hash").orderBy("number")  # a document's chunks at most
    shared = (
        repeats.distinct()
        .withColumn("run", F.col("number") - F.row_number().over(in_text))
        .groupBy("doc_id", "text_hash", "run", "source", "shift")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sum("begun").alias("begun"))
    )
    runs = shared.groupBy("doc_id", "text_hash", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("n").alias("n_chunks"),
        F.sum("begun").alias("n_words"),
        F.min(F.struct((-F.col("n")).alias("less"), "source", "shift", "start", "end")).alias("best"),
    )
    runs = materialise(runs.where(F.col("n_words") * SEED_PART >= least_words), "runs")
    return _grown(docs, runs).where(F.col("n_words") >= least_words)


def _grown(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Spans of the runs, grown on both sides."""
    ends = {
        f"{who}{side}": F.struct(F.lit(f"{who}{side}").alias("role"), of.alias("of"), (F.col(spot) + shift).alias("spot"), F.lit(side).alias("side"))
        for who, of, shift in (("own", F.col("text_hash"), F.lit(0)), ("other", F.col("best.source.text_hash"), F.col("best.shift")))
        for side, spot in enumerate(("best.start", "best.end"))
    }
    of_run = ["start", "end", "first", "last", "n_chunks", "n_words"]
    runs = runs.select("*", F.col("best.start").alias("first"), F.col("best.end").alias("last"))
    asks = runs.select("doc_id", "text_hash", "run", *of_run, F.col("best.source.doc_id").alias("source_doc_id"), F.explode(F.array(*ends.values())).alias("ask"))
    asks = asks.select("*", "ask.*").drop("ask")
    asked = materialise(asks.groupBy("of", "spot", "side").agg(F.count("*").alias("n")), "asked")
    known = materialise(edges(docs, asked), "edges")
    top = asked.orderBy(F.desc("n"), "of", "spot", "side").limit(HEAVY_LIMIT)
    often = known.join(F.broadcast(top), ["of", "spot", "side"], "left_semi")  # a thousand edges of up to 256 bytes
    met = spread_join(asks, known, often, ["of", "spot", "side"], ["edge"], ["text_hash", "run"])
    met = met.groupBy("doc_id", "text_hash", "run").agg(
        *[F.max(c).alias(c) for c in (*of_run, "source_doc_id")], *[F.max(F.when(F.col("role") == role, F.col("edge"))).alias(role) for role in ends]
    )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, end, first, last, n_words = (batch.column(c).to_numpy() for c in ("start", "end", "first", "last", "n_words"))
            within = (first - start, end - last)
            sides = [growth(batch.column(f"own{k}").to_pylist(), batch.column(f"other{k}").to_pylist(), within[k], k) for k in (0, 1)]
            columns = [start - sides[0][0], end + sides[1][0], batch.column("n_chunks"), n_words + sides[0][1] + sides[1][1]]
            names = ["doc_id", "span_start", "span_end", "n_chunks", "n_words", "source_doc_id"]
            arrays = [batch.column("doc_id"), *[x if isinstance(x, pa.Array) else pa.array(x) for x in columns], batch.column("source_doc_id")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return arrow_map(met.drop("text_hash", "run"), grow, "doc_id long, span_start long, span_end long, n_chunks long, n_words long, source_doc_id long")
