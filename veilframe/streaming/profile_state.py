"""Counts of classes and values, kept over the micro-batches of a stream.

Every batch leaves its own counts in a folder named by its number. Folders of two equal aligned spans of batches are merged into
one, so that n batches lie in at most log2(n) + 1 folders and each count is rewritten as often. All names follow from the batch
number and a merge reads only what earlier batches have left: a batch that is repeated writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.operators.privacy import merged_profile
from veilframe.sources.files import names_in, remove


def spans(n: int) -> list[tuple[int, int]]:
    """Batches 0 to n - 1 as (first, size) of aligned spans, whose sizes are powers of two."""
    out, first = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            out.append((first, 1 << bit))
            first += 1 << bit
    return out


class ProfileState:
    """The value profile (see ``privacy.value_profile``) of all batches so far, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, qi: Sequence[str]):
        self.spark, self.path, self.qi = spark, path.rstrip("/"), list(qi)

    def _place(self, span: tuple[int, int]) -> str:
        return f"batches-{span[0]:012d}-{span[1]:012d}"

    def _there(self) -> set[tuple[int, int]]:
        return {tuple(int(x) for x in name.split("-")[1:]) for name in names_in(self.spark, self.path)}

    def _read(self, some: Sequence[tuple[int, int]]) -> DataFrame | None:
        there, paths, left = self._there(), [], list(some)
        while left:
            first, size = left.pop()
            if (first, size) in there:
                paths.append(f"{self.path}/{self._place((first, size))}")
            elif size > 1:  # a batch in it never ran, so that its halves were not merged
                left += [(first, size // 2), (first + size // 2, size // 2)]
        return merged_profile(self.spark.read.parquet(*paths), self.qi) if paths else None

    def add(self, profile: DataFrame, number: int) -> None:
        """Take in the counts of batch ``number``, the first or a repeated time."""
        # The batches before this one are done: what their merges have replaced can go.
        done = {(first, size) for first, size in self._there() if first + size <= number}
        for first, size in done:
            if any(f <= first and first + size <= f + n and n > size for f, n in done):
                remove(self.spark, f"{self.path}/{self._place((first, size))}")
        profile.write.mode("overwrite").parquet(f"{self.path}/{self._place((number, 1))}")
        end, size = number + 1, 1
        while end % (2 * size) == 0:
            both = self._read([(end - 2 * size, size), (end - size, size)])
            both.write.mode("overwrite").parquet(f"{self.path}/{self._place((end - 2 * size, 2 * size))}")
            size *= 2

    def upto(self, number: int) -> DataFrame | None:
        """The counts of batches 0 to ``number``; None before the first."""
        return self._read(spans(number + 1))
