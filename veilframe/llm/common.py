"""Helpers of the operators: texts as byte arrays, word hashes, durable tables, a fixed-size membership filter.

Texts arrive as Arrow batches. They are cut into slices of half a megabyte (a longer text is a slice of its own), and
all numpy work runs over the bytes of a slice at once, so that memory depends on the longest text and not on the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.session import materialise

SLICE_BYTES = 1 << 19
U64 = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

#: Bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_CODES = mixed(np.arange(1, 257, dtype=U64) * U64(GOLDEN))
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n - 1."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(size, base, U64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of ``values`` (codes, not raw bytes); equal spans, equal hashes."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=total[1:])
    lengths = (ends - starts).astype(U64)
    return mixed((total[ends] - total[starts]) * down[starts] + lengths * U64(GOLDEN))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column end to end, and where each text starts; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, 8 * column.offset)
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of about ``limit`` bytes: the rows, their bytes, the offsets of the texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = packed(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs without separators (``[^\\x20\\x09-\\x0D]+``); none spans two texts."""
    inside = ~between[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    cuts = offsets[1:-1]
    before[cuts] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[cuts] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased."""
    return span_hashes(BYTE_CODES[LOWER[data]], starts, ends)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive word hashes; shorter input gives none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for k in range(size):
        total = total * _BASE + hashes[k : k + n]
    return mixed(total)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(name) for name, c in columns.items()])


def share(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """About ``rows`` rows of ``df``, or all if it has fewer: those whose hashed key is low enough, the same at every run."""
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(17), *key), F.lit(cells)) < int(min(1.0, rows / max(1, df.count())) * cells))


def arrow_map(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(make, schema)


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values end to end."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column from a two-dimensional array, a value for each of its rows."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


FILTER_BITS = 1 << 26


def membership(keys: DataFrame, column: str):
    """A broadcast bit set of ``FILTER_BITS`` bits (8 MB at any input) that holds at least the given 64-bit keys.

    It only saves shuffling: whoever uses it joins with the exact keys afterwards.
    """
    spot = F.pmod(F.col(column), F.lit(FILTER_BITS))
    cells = (
        keys.select((spot / 64).cast("long").alias("cell"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
    )
    got = cells.toArrow()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[got["cell"].to_numpy()] = got["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(U64))


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each unsigned 64-bit key whether the bit set may hold it."""
    spot = keys & U64(FILTER_BITS - 1)
    return (bits[spot >> U64(6)] >> (spot & U64(63))) & U64(1) == 1


def components(edges: DataFrame, label: str, tidy: bool = False) -> DataFrame:
    """(node, component) of undirected edges (a, b): the smallest node reachable; nodes without edges are absent.

    Alternates large-star and small-star rewiring until nothing changes; each round is a stored table. Aggregates and
    joins on a node only, so a hub is split by adaptive execution, and rounds grow with the logarithm of the longest chain.
    With ``tidy`` shuffle files of a round go with it.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, tidy)
    seen = None
    while True:
        around = both(current)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        large = materialise(large, label, tidy)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("e"))
            .select(F.col("e.b").alias("a"), F.col("e.low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        current = materialise(small, label, tidy)
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
