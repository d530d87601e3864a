"""Periodic runs of words by online dyadic square catching.

Words arrive in order. Every aligned block of 2^k words has a catcher as soon as it is complete: it watches the windows of
2^k words that end later and compares them with its block. A window that equals the block at a distance q makes a suspected
repetition of period q, whose equal stretch is followed to the left at once and to the right as words arrive. A stretch of
q or more equal words is a square; squares of one stretch are one run. The catchers of level k watch the distances
2^(k+1) - 1 to 2^(k+2) - 2, so that each period belongs to one level and the first half of every square holds a complete block.

Words may arrive one by one or many at a time; all catchers of a level are then advanced together. Words are compared by
64-bit hashes of their bytes and stretches by hashes modulo two primes (62 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BYTE_CODES, U64, arrow_map, pick, slices, span_hashes, words

#: Words that are taken in at a time.
FEED = 1 << 16
#: Primes and bases of the stretch hashes.
PRIMES = (U64(2147483647), U64(2147483629))
BASES = (1103515245, 1664525)


def _powers(base: int, prime: U64, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo ``prime``, by doubling."""
    out = np.ones(1, U64)
    while len(out) < n:
        step = U64(pow(base, len(out), int(prime)))
        out = np.concatenate([out, out * step % prime])
    return out[:n]


class SquareCatcher:
    """The catchers over texts that lie end to end, longest first; no repetition spans two texts.

    ``take(n)`` lets the next ``n`` words arrive; ``runs()`` gives what the words so far hold. ``table`` has a row (first
    position, end of the equal stretch, period) for each square-bearing stretch and each stretch that still touches the last
    word. ``least`` is the smallest exponent of interest, at least 2: texts shorter than ``least`` periods of a level skip it.
    """

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, least: int = 2):
        if least < 2:
            raise ValueError("a square has an exponent of 2")
        self.offsets, self.least, self.arrived = offsets.astype(np.int64), least, 0
        lengths = np.diff(self.offsets)
        if (np.diff(lengths) > 0).any():
            raise ValueError("texts have to be sorted, the longest first")
        self.lengths = lengths
        n = len(hashes)
        self.power = [_powers(b, p, n + 1) for b, p in zip(BASES, PRIMES)]
        self.total = []
        for i, prime in enumerate(PRIMES):
            code = (hashes >> U64(31 * i)) % prime
            self.total.append(np.concatenate([np.zeros(1, U64), np.cumsum(code * self.power[i][:n] % prime)]))
        inverse = pow(BASES[0], -1, int(PRIMES[0]))
        self.inverse = _powers(inverse, PRIMES[0], n + 1)
        self.seen: list[int] = []  # for each level, how many windows were compared
        self.table = np.zeros((0, 3), np.int64)

    def _equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words at a and at b, with a < b, are the same."""
        same = np.ones(len(a), bool)
        for prime, power, total in zip(PRIMES, self.power, self.total):
            left = (total[a + size] - total[a]) % prime * power[b - a] % prime
            same &= left == (total[b + size] - total[b]) % prime
        return same

    def _reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from a and b on (or before them) are the same, ``most`` at most."""
        got = np.zeros(len(a), np.int64)
        if not len(a):
            return got
        step = 1 << int(most.max()).bit_length()
        while step:
            fits = np.flatnonzero(got + step <= most)
            if len(fits):
                shift = -(got[fits] + step) if back else got[fits]
                size = np.full(len(fits), step, np.int64)
                good = fits[self._equal(a[fits] + shift, b[fits] + shift, size)]
                got[good] += step
            step >>= 1
        return got

    def _text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def _caught(self, level: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and distances of the windows of a level that are complete now and were not compared before."""
        size = 1 << level
        windows = upto - size + 1
        low, self.seen[level] = self.seen[level], max(self.seen[level], windows)
        if windows <= low:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Whole rows of windows, one row for each block that is the nearest to be watching.
        first = max(0, (low - (2 * size - 1)) // size)
        last = (windows - 1 - (2 * size - 1)) // size
        if last < first:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, rows = first * size, last - first + 1
        behind = max(0, start - size)
        end = min(start + 2 * size - 1 + rows * size, windows)
        at = np.arange(behind, end)
        prime, total = PRIMES[0], self.total[0]
        name = (total[at + size] - total[at]) % prime * self.inverse[at] % prime
        window = np.full(rows * size, prime, U64)  # a name that no window has
        part = name[start + 2 * size - 1 - behind :]
        window[: len(part)] = part
        window = window.reshape(rows, size)
        blocks = start + size * np.arange(rows)
        out = []
        for back in (0, size):
            mine = blocks - back
            known = mine >= 0
            own = np.where(known, name[np.maximum(mine - behind, 0)], prime + U64(1))
            i, j = np.nonzero(window == own[:, None])
            at_window = blocks[i] + 2 * size - 1 + j
            fresh = at_window >= low
            out.append((mine[i][fresh], (at_window - mine[i])[fresh]))
        block, distance = (np.concatenate(x) for x in zip(*out))
        inside = self._text_of(block) == self._text_of(block + distance + size - 1)
        return block[inside], distance[inside]

    def _known(self, block: np.ndarray, distance: np.ndarray, size: int) -> np.ndarray:
        """Whether a run of a period of at most ``size`` holds the block and its copy: the copy then tells nothing new."""
        old = self.table[(self.table[:, 1] - self.table[:, 0] >= self.table[:, 2]) & (self.table[:, 2] <= size)]
        if not len(old) or not len(block):
            return np.zeros(len(block), bool)
        old = old[np.argsort(old[:, 0], kind="stable")]
        ends = np.maximum.accumulate(old[:, 1] + old[:, 2])
        at = np.searchsorted(old[:, 0], block, "right") - 1
        return (at >= 0) & (ends[np.maximum(at, 0)] >= block + distance + size)

    def _follow(self, block: np.ndarray, distance: np.ndarray, size: int, upto: int) -> np.ndarray:
        """The equal stretches of the catches, a row (first, end, period) for each."""
        order = np.lexsort((block, distance))
        block, distance = block[order], distance[order]
        # Neighbouring blocks with one distance lie in one stretch: only the first is followed left, only the last right.
        joined = (distance[1:] == distance[:-1]) & (block[1:] - block[:-1] == size)
        head, tail = np.append(True, ~joined), np.append(~joined, True)
        first, last, period = block[head], block[tail], distance[head]
        text = self._text_of(first)
        first = first - self._reach(first, first + period, first - self.offsets[text], back=True)
        stop = np.minimum(self.offsets[text + 1], upto) - period
        end = last + self._reach(last, last + period, stop - last, back=False)
        return np.stack([first, end, period], axis=1)

    def take(self, n: int) -> None:
        """The next ``n`` words arrive."""
        old, upto = self.arrived, min(self.arrived + n, int(self.offsets[-1]))
        self.arrived = upto
        table = self.table
        # Suffix comparisons of the stretches that touched the last word go on.
        open_ = np.flatnonzero(table[:, 1] + table[:, 2] == old)
        if len(open_):
            first, end, period = table[open_].T
            stop = np.minimum(self.offsets[self._text_of(first) + 1], upto) - period
            table[open_, 1] = end + self._reach(end, end + period, stop - end, back=False)
        level = 0
        while True:
            size = 1 << level
            # Texts that can hold a run of this level's periods; they lie in front.
            able = int(np.searchsorted(-self.lengths, -self.least * (2 * size - 1), "right"))
            if not able:
                break
            if len(self.seen) == level:
                self.seen.append(0)
            block, distance = self._caught(level, min(upto, int(self.offsets[able])))
            fresh = ~self._known(block, distance, size)
            if fresh.any():
                found = self._follow(block[fresh], distance[fresh], size, upto)
                found = found[found[:, 1] > found[:, 0]]
                self.table = self._merged(np.concatenate([self.table, found]))
            level += 1
        square = self.table[:, 1] - self.table[:, 0] >= self.table[:, 2]
        self.table = self.table[square | (self.table[:, 1] + self.table[:, 2] == upto)]

    @staticmethod
    def _merged(table: np.ndarray) -> np.ndarray:
        """One row for each stretch, the longest seen of it."""
        order = np.lexsort((-table[:, 1], table[:, 0], table[:, 2]))
        table = table[order]
        new = np.append(True, (table[1:, 2] != table[:-1, 2]) | (table[1:, 0] != table[:-1, 0]))
        return table[new]

    def runs(self, least_length: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start in the text, length and smallest period of the runs so far, by text, start and period."""
        start, length, period = self.table[:, 0], self.table[:, 1] - self.table[:, 0] + self.table[:, 2], self.table[:, 2]
        keep = (length >= self.least * period) & (length >= least_length)
        start, length, period = start[keep], length[keep], period[keep]
        # Stretches of the same words are one run, whose period is the smallest of theirs.
        order = np.lexsort((period, length, start))
        start, length, period = start[order], length[order], period[order]
        new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[: len(start)]
        start, length, period = start[new], length[new], period[new]
        order = np.lexsort((period, start))
        start, length, period = start[order], length[order], period[order]
        text = self._text_of(start)
        return text, start - self.offsets[text], length, period


def runs_of(hashes: np.ndarray, counts: np.ndarray, least: int = 4, least_length: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of the runs of texts whose word hashes lie end to end, by text, start and period."""
    order = np.argsort(-counts, kind="stable")
    begin = np.cumsum(counts) - counts
    sizes = counts[order]
    at = np.repeat(begin[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    catcher = SquareCatcher(hashes[at], np.concatenate([[0], np.cumsum(sizes)]), least)
    while catcher.arrived < len(hashes):
        catcher.take(FEED)
    text, start, length, period = catcher.runs(least_length)
    text = order[text]
    back = np.lexsort((period, start, text))
    return text[back], start[back], length[back], period[back]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given words of each text with one space between them: bytes end to end, and offsets."""
    sizes = ends - starts + 1
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    gaps = np.cumsum(sizes) - 1
    at[gaps] = 0
    out = data[at] if len(data) else np.zeros(0, np.uint8)
    out[gaps] = ord(" ")
    last = np.cumsum(counts)[counts > 0] - 1  # no space after a text's last word
    keep = np.ones(len(out), bool)
    keep[gaps[last]] = False
    total = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    return out[keep], total - np.concatenate([[0], np.cumsum(counts > 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 4, least_length: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start and period) and collapsed of every row.

    A run is a stretch of consecutive words (``[^\\x20\\x09-\\x0D]+``, numbered from 0) of smallest period q, at least
    ``least_length`` words and ``least`` * q long, that no neighbouring word extends with that period. ``collapsed`` is the text
    without the words that some run contains after its first q words, one space between words. Null and empty texts have
    no words, no runs and an empty collapsed text. Null ids and rows that repeat are rows of their own; ties cannot occur, since
    no two runs share start and period. A text is worked on by one task, in memory of some ninety bytes a word and in time
    n log n, however long it is. Other columns play no part. An empty table gives an empty result.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            starts, ends, owner = words(data, offsets)
            counts = np.bincount(owner, minlength=rows.num_rows)
            text, start, length, period = runs_of(span_hashes(BYTE_CODES[data], starts, ends), counts, least, least_length)
            begin = np.cumsum(counts) - counts
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, begin[text] + start + period, 1)
            np.add.at(change, begin[text] + start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            out, bounds = joined(data, starts[kept], ends[kept], np.bincount(owner[kept], minlength=rows.num_rows))
            whole = pa.Array.from_buffers(
                pa.large_string(), rows.num_rows, [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]
            )
            each = np.bincount(text, minlength=rows.num_rows)
            parts = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
            spots = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(spots, parts), whole.cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_map(rows, make, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
