"""Best-fit packing of documents into sequences of a fixed number of tokens.

Pieces above a third of the capacity go at most two to a sequence: from the longest down, each is matched with the longest
other that still fits beside it. Smaller pieces, from the longest down, go where the least room is left that still takes
them. Only lengths matter for that, so the plan is made from the histogram of lengths, which has at most ``capacity`` rows
at any input; a piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, pick
from veilframe.llm.tokens import Encoder, default_vocabulary, encoder_slices
from veilframe.operators.ordered import with_row_index
from veilframe.session import materialise


def plan(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, low, high, sequence, offset): pieces of that length and rank low to high - 1 go to consecutive sequences."""
    left = [0] * (capacity + 1)
    for length, count in lengths.items():
        left[length] = count
    done = [0] * (capacity + 1)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: first sequence, how many
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        if count:
            out.append((length, done[length], done[length] + count, first, offset))
            done[length] += count
            left[length] -= count

    large = [n for n in range(capacity, 0, -1) if 3 * n > capacity]
    for length in large:
        for partner in (n for n in large if n <= min(length, capacity - length)):
            both = left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, both, sequences, 0)
            put(partner, both, sequences, length)
            if both:
                gaps[capacity - length - partner].append((sequences, both))
            sequences += both
            if not left[length]:
                break
        if alone := left[length]:
            gaps[capacity - length].append((sequences, alone))
            put(length, alone, sequences, 0)
            sequences += alone

    for length in range(capacity // 3, 0, -1):
        while left[length]:
            room = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if room is None:
                room, need = capacity, -(-left[length] // (capacity // length))
                gaps[capacity].append((sequences, need))
                sequences += need
            first, count = gaps[room].pop()
            copies = room // length
            full = min(count, left[length] // copies)
            for k in range(copies):
                put(length, full, first, capacity - room + k * length)
            if full:
                gaps[room - copies * length].append((first, full))
            first, count = first + full, count - full
            if count and (rest := min(left[length], copies)):
                for k in range(rest):
                    put(length, 1, first, capacity - room + k * length)
                gaps[room - rest * length].append((first, 1))
                first, count = first + 1, count - 1
            if count:
                gaps[room].append((first, count))
    return out


def token_pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of every document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(vocabulary)
        for rows, data, offsets in encoder_slices(batches):
            ids, counts = encoder.encode(data, offsets)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            counts = counts + 1
            begin = np.cumsum(counts) - counts
            pieces = -(-counts // capacity)
            of = np.repeat(np.arange(len(counts)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = counts - (pieces - 1) * capacity  # the first piece takes what full pieces leave
            start = np.where(piece == 0, 0, head[of] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[of], capacity)
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip((begin[of] + start).tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return arrow_map(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, vocabulary: str | None = None, end_id: int = 2
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece of each document.

    A document is its ids and ``end_id``; one longer than ``capacity`` is cut into full pieces, of which the first may be
    shorter. A null or empty text is the end id alone. Rows that repeat, or a null id, are documents of their own. Pieces of
    one length are ranked by id, piece and checksum. Other columns play no part. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = materialise(token_pieces(docs, capacity, vocabulary or default_vocabulary(), end_id), "pieces")
    ranked = with_row_index(pieces, ["length", "doc_id", "piece", "ids_crc32"], "_index")
    histogram = pieces.groupBy("length").count().collect()  # at most ``capacity`` rows
    lengths = dict(sorted((r["length"], r["count"]) for r in histogram))
    before, seen = {}, 0
    for length, count in lengths.items():
        before[length], seen = seen, seen + count
    places = pieces.sparkSession.createDataFrame(
        [(n, before[n] + low, before[n] + high, first, offset) for n, low, high, first, offset in plan(lengths, capacity)],
        "length long, _low long, _high long, _first long, offset long",
    )
    # The plan's size depends on the capacity only, hence the broadcast.
    placed = ranked.join(F.broadcast(places), "length").where("_index >= _low AND _index < _high")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_index") - F.col("_low")).alias("sequence_id"), "offset")


def length_histogram(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """length, n_docs: how many texts encode to how many tokens; null and empty texts have length 0.

    Rows that repeat are texts of their own, whatever their id. Texts of any length are encoded whole, long runs of white space
    included. Other columns play no part. An empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(path), {}
        for _, data, offsets in encoder_slices(batches):
            for length, count in zip(*(x.tolist() for x in np.unique(encoder.counts(data, offsets), return_counts=True))):
                seen[length] = seen.get(length, 0) + count
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["length", "n_docs"])

    return arrow_map(pick(docs, text=text_col), make, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


BLOCK = 4096


def context_totals(histogram: DataFrame) -> DataFrame:
    """What every context limit costs, from the exact histogram of lengths.

    length (the limit), n_docs and tokens of that length, docs_longer and tokens_longer (suffix sums), docs_at_most,
    rank_low and rank_high (the quantiles whose value is this length: low < q <= high), kept_tokens (the total when every
    document is cut to the limit) and lost_tokens. Limits between two lengths follow from the next lower row:
    kept_tokens + docs_longer * (limit - length). Other columns play no part; each length has one row. An empty histogram gives
    an empty result.
    """
    histogram = materialise(histogram, "lengths").withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("_block", F.floor(F.col("length") / BLOCK))
    # A row for each block of lengths: their number depends on the longest text only.
    blocks = histogram.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t"))
    after = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select(
        "_block",
        *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in ("_d", "_t")],
        *[F.sum(c).over(Window.partitionBy()).alias(name) for c, name in (("_d", "_docs"), ("_t", "_tokens"))],
    )
    inside = Window.partitionBy("_block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    suffix = lambda c, more: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(more)
    return (
        histogram.join(F.broadcast(later), "_block")
        .withColumns({"docs_longer": suffix("n_docs", "_d_after"), "tokens_longer": suffix("tokens", "_t_after")})
        .select(
            "length",
            "n_docs",
            "tokens",
            "docs_longer",
            "tokens_longer",
            (F.col("_docs") - F.col("docs_longer")).alias("docs_at_most"),
            ((F.col("_docs") - F.col("docs_longer") - F.col("n_docs")) / F.col("_docs")).alias("rank_low"),
            ((F.col("_docs") - F.col("docs_longer")) / F.col("_docs")).alias("rank_high"),
            (F.col("_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("length")).alias("kept_tokens"),
            (F.col("tokens_longer") - F.col("docs_longer") * F.col("length")).alias("lost_tokens"),
        )
    )
