"""Exact order statistics without sorting or shuffling the data.

Every target rank keeps an open value interval that is known to hold it. ``percentile_approx`` narrows
the interval by a factor of thousands per scan, counts say on which side the target lies, and once an
interval holds few rows they are sorted as one small array. Each pass is a single aggregation with
partial results of bounded size; the driver sees a few numbers per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 20_000  # rows an interval may hold before its values are put into one array
ACCURACY = 10_000
COLUMNS_PER_SCAN = 32  # bounds the sketches and arrays one task holds for a wide table


@dataclass
class _Target:
    column: str
    rank: int  # 0-based among the non-null values
    rows: int  # rows inside the interval
    below: int = 0  # rows at or under the lower bound
    low: float | None = None
    high: float | None = None
    value: float | None = None

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def inside(self) -> Column:
        c = F.col(self.column)  # in its own type: doubles cannot tell large integers apart
        cond = c.isNotNull()
        if self.low is not None:
            cond &= c > F.lit(self.low)
        if self.high is not None:
            cond &= c < F.lit(self.high)
        return F.when(cond, c)


def _by_interval(targets: list[_Target]) -> list[list[_Target]]:
    groups: dict[tuple, list[_Target]] = {}
    for t in targets:
        groups.setdefault(t.interval, []).append(t)
    return list(groups.values())


def _finish_small(df: DataFrame, targets: list[_Target]) -> None:
    """All targets whose interval is small: pick from its sorted values."""
    groups = _by_interval(targets)
    wanted = reduce(lambda a, b: a | b, [g[0].inside().isNotNull() for g in groups])
    lists = df.filter(wanted).agg(*[F.sort_array(F.collect_list(g[0].inside())).alias(f"a{i}") for i, g in enumerate(groups)])
    found = lists.select(
        *[F.array(*[F.element_at(f"a{i}", t.rank - t.below + 1) for t in g]).alias(f"a{i}") for i, g in enumerate(groups)]
    ).first()
    for i, g in enumerate(groups):
        for t, value in zip(g, found[f"a{i}"]):
            t.value = value


def _narrow(df: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """Two scans: bracket each target, then count the rows under and at the bracket's ends.

    One sketch serves all targets of an interval. Probabilities are put on the sketch's own grid, so that
    neighbouring ranks share their bracket.
    """
    margin = 2.0 / accuracy

    def bracket(t: _Target) -> list[float]:
        local = t.rank - t.below
        low, high = local / t.rows - margin, (local + 1) / t.rows + margin
        return [max(0.0, math.floor(low * accuracy) / accuracy), min(1.0, math.ceil(high * accuracy) / accuracy)]

    groups = _by_interval(targets)
    sketches = [
        F.percentile_approx(g[0].inside(), [p for t in g for p in bracket(t)], accuracy).alias(f"b{i}") for i, g in enumerate(groups)
    ]
    found = df.agg(*sketches).first()
    ends = {id(t): found[f"b{i}"][2 * j : 2 * j + 2] for i, g in enumerate(groups) for j, t in enumerate(g)}

    bounds = list({(t.column, v) for t in targets for v in ends[id(t)]})
    counts = []
    for i, (c, v) in enumerate(bounds):
        x = F.col(c)
        counts += [F.sum((x < F.lit(v)).cast("int")).alias(f"l{i}"), F.sum((x == F.lit(v)).cast("int")).alias(f"e{i}")]
    seen = df.agg(*counts).first()
    under = {b: seen[f"l{i}"] for i, b in enumerate(bounds)}
    equal = {b: seen[f"e{i}"] for i, b in enumerate(bounds)}

    for t in targets:
        lo, hi = ends[id(t)]
        at_lo, at_hi = (t.column, lo), (t.column, hi)
        if t.rank < under[at_lo]:
            t.high, t.rows = lo, under[at_lo] - t.below
        elif t.rank < under[at_lo] + equal[at_lo]:
            t.value = lo
        elif t.rank < under[at_hi]:
            t.low, t.high, t.below = lo, hi, under[at_lo] + equal[at_lo]
            t.rows = under[at_hi] - t.below
        elif t.rank < under[at_hi] + equal[at_hi]:
            t.value = hi
        else:
            passed = under[at_hi] + equal[at_hi]
            t.low, t.rows, t.below = hi, t.rows - (passed - t.below), passed


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    counts: dict[str, int] | None = None,
    small: int = SMALL,
    accuracy: int = ACCURACY,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the non-null values, exact at any size; values of a column keep its type."""
    if counts is None and cols:
        found = df.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        counts = {c: found[f"n{i}"] for i, c in enumerate(cols)}
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(cols), COLUMNS_PER_SCAN):
        out |= _quantiles(df, cols[start : start + COLUMNS_PER_SCAN], probs, counts, small, accuracy)
    return out


def _quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], counts: dict[str, int], small: int, accuracy: int
) -> dict[str, list[float | None]]:
    targets: dict[tuple[str, int], _Target] = {}
    for c in cols:
        for p in probs if counts[c] else ():
            h = p * (counts[c] - 1)
            for rank in (math.floor(h), math.ceil(h)):
                targets.setdefault((c, rank), _Target(c, rank, counts[c]))

    open_targets = list(targets.values())
    while open_targets:
        few = [t for t in open_targets if t.rows <= small]
        if few:
            _finish_small(df, few)
        many = [t for t in open_targets if t.rows > small]
        if many:
            _narrow(df, many, accuracy)
        open_targets = [t for t in many if t.value is None]

    def at(c: str, p: float) -> float | None:
        if not counts[c]:
            return None
        h = p * (counts[c] - 1)
        lo, hi, part = targets[c, math.floor(h)].value, targets[c, math.ceil(h)].value, h - math.floor(h)
        if lo == hi or not part:
            return lo
        if isinstance(lo, Decimal):
            return lo + (hi - lo) * Decimal(part)
        if isinstance(lo, int) and part == 0.5 and (lo + hi) % 2 == 0:
            return (lo + hi) // 2
        return (lo + hi) / 2 if part == 0.5 else lo + part * (hi - lo)

    return {c: [at(c, p) for p in probs] for c in cols}
