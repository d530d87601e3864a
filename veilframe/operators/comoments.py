"""Means, deviations and correlations of many columns from one scan, by states that can be merged.

A task turns blocks of rows into one state for each table: count, mean and squared deviations of every column over its known
values, and count, means and the matrix of products of deviations over the complete rows. Two states are merged exactly, without
cancellation of large sums, in two steps, so that no task holds more than about the square root of all states. The plan does not
grow with the width; a state has the square of the width in numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.schema import find_column

GROUPS = 256


@dataclass
class CoMoments:
    """``known``, ``mean`` and ``squares`` by column; ``rows``, ``centre`` and ``products`` of the complete rows."""

    known: np.ndarray
    mean: np.ndarray
    squares: np.ndarray
    rows: float
    centre: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray, valid: np.ndarray) -> CoMoments:
        """The state of a block; a NaN is a known value, and keeps its row from being complete."""
        known = valid.sum(0).astype(float)
        filled = np.where(valid, values, 0.0)
        mean = filled.sum(0) / np.maximum(known, 1)
        squares = np.where(valid, (filled - mean) ** 2, 0.0).sum(0)
        whole = values[(valid & ~np.isnan(values)).all(1)]
        centre = whole.mean(0) if len(whole) else np.zeros(values.shape[1])
        off = whole - centre
        return cls(known, mean, squares, float(len(whole)), centre, off.T @ off)

    def merge(self, other: CoMoments) -> CoMoments:
        known, rows = self.known + other.known, self.rows + other.rows
        part, share = other.known / np.maximum(known, 1), other.rows / max(rows, 1)
        gap, shift = other.mean - self.mean, other.centre - self.centre
        return CoMoments(
            known,
            np.where(self.known > 0, self.mean + gap * part, other.mean),
            self.squares + other.squares + np.where((self.known > 0) & (other.known > 0), gap * gap * self.known * part, 0.0),
            rows,
            self.centre + shift * share,
            self.products + other.products + np.outer(shift, shift) * (self.rows * share),
        )

    def pack(self) -> bytes:
        return np.concatenate([self.known, self.mean, self.squares, [self.rows], self.centre, self.products.ravel()]).tobytes()

    @classmethod
    def unpack(cls, blob: bytes, k: int) -> CoMoments:
        x = np.frombuffer(blob, float)
        return cls(x[:k], x[k : 2 * k], x[2 * k : 3 * k], float(x[3 * k]), x[3 * k + 1 : 4 * k + 1], x[4 * k + 1 :].reshape(k, k))

    def deviation(self) -> np.ndarray:
        """Population deviation of the known values, NaN where there are none."""
        return np.sqrt(np.divide(self.squares, self.known, out=np.full(len(self.known), np.nan), where=self.known > 0))

    def correlations(self) -> np.ndarray:
        """Of the complete rows; NaN for constant columns and for fewer than two rows."""
        spread = np.sqrt(np.diag(self.products))
        spread = np.where((spread > 0) & (self.rows >= 2), spread, np.nan)
        return np.clip(self.products / spread[:, None] / spread[None, :], -1, 1)


def co_moments(tables: Sequence[DataFrame], cols: Sequence[str]) -> list[CoMoments]:
    """The state of each table over ``cols``, which all of them have; the driver sees one state for each."""
    k = len(cols)
    sides = [df.select(F.lit(i).alias("side"), F.array(*[F.col(find_column(df, c)).cast("double") for c in cols]).alias("x")) for i, df in enumerate(tables)]
    schema = "side int, part int, state binary"

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, CoMoments] = {}
        for batch in batches:
            side = batch.column(0).to_numpy()
            flat = batch.column(1).flatten()
            values = flat.to_numpy(zero_copy_only=False).reshape(-1, k).astype(float)
            valid = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, k)
            for i in np.unique(side).tolist():
                state = CoMoments.of(values[side == i], valid[side == i])
                held[i] = held[i].merge(state) if i in held else state
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array([s.pack() for s in held.values()], pa.binary())],
            ["side", "part", "state"],
        )

    def merged(group: pa.Table) -> pa.Table:
        states = (CoMoments.unpack(blob, k) for blob in group["state"].to_pylist())
        return group.slice(0, 1).set_column(2, "state", pa.array([reduce(CoMoments.merge, states).pack()], pa.binary()))

    states = reduce(DataFrame.unionAll, sides).mapInArrow(make, schema)
    by_part = states.groupBy("side", "part").applyInArrow(merged, schema)
    done = {r["side"]: CoMoments.unpack(bytes(r["state"]), k) for r in by_part.groupBy("side").applyInArrow(merged, schema).collect()}
    empty = CoMoments.of(np.zeros((0, k)), np.zeros((0, k), bool))
    return [done.get(i, empty) for i in range(len(tables))]
