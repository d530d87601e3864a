"""A random forest for tables of any size, grown in parts.

Features are cut into at most 32 bins, so the table is first counted by cell (bins and label); a bag draws a Poisson number for each
cell, which is the sum of what its rows would draw. Nodes with many cells are split by histograms that all tasks add up; nodes with
few are dealt out, and a task grows everything below one of them. Draws depend on the cell, the tree and the node alone, so the
forest is the same however the table is partitioned and wherever the nodes are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.operators.ordered import with_row_index
from veilframe.session import materialise

BINS = 32
#: Nodes of more cells are split by histograms over all tasks; no group of rows holds more cells to learn from or to score.
PART_CELLS = 1 << 17
#: Entries of the histograms that are counted at once, in a task or for the nodes of a part.
SLOTS = 1 << 21
#: Votes are added as whole numbers, so that their sum does not depend on its order.
VOTE = 1 << 40
U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _tree_keys(trees: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, trees + 1, dtype=U64) * _GOLDEN + _mixed(np.array([seed], np.int64).view(U64)))


def thresholds(rows: DataFrame, cols: Sequence[str]) -> list[list[float]]:
    """Where each column is cut: between all of its values if they are few, else at quantiles of all rows."""
    values = rows.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(c).alias("x")) for i, c in enumerate(cols)])))
    first = values.distinct().withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy("x"))).filter(F.col("place") <= BINS + 1)
    few: list[list[float]] = [[] for _ in cols]
    for r in first.orderBy("at", "place").collect():
        few[r["at"]].append(r["x"])
    many, n = [i for i, v in enumerate(few) if len(v) > BINS], rows.count()
    points: dict[int, set[float]] = {i: set() for i in many}
    if many:
        # Every column has n values, so that the ranks of a column follow those of the columns before it; a number of each row
        # keeps a frequent value from lying in one range.
        placed = values.filter(F.col("at").isin(many)).withColumn("row", F.monotonically_increasing_id())
        ranked = with_row_index(placed, ["at", "x", "row"], "rank")
        ranks = [k * n + i * n // BINS for k in range(len(many)) for i in range(1, BINS)]
        for r in ranked.filter(F.col("rank").isin(ranks)).collect():
            points[r["at"]].add(r["x"])
    between = lambda v: sorted({a + (b - a) / 2 if a + (b - a) / 2 > a else b for a, b in pairwise(v)})
    return [sorted(points[i] - {v[0]}) if i in points else between(v) for i, v in enumerate(few)]


def _binned(rows: DataFrame, width: int, bounds: list[list[float]]) -> DataFrame:
    """Counted cells: the bins ``b0`` and on, label, rows."""
    x = vector_to_array("features")
    plain = rows.select("label", *[x[i].alias(f"x{i}") for i in range(width)])
    cut = [i for i, b in enumerate(bounds) if b]
    if cut:
        splits = [[-float("inf"), *bounds[i], float("inf")] for i in cut]
        plain = Bucketizer(splitsArray=splits, inputCols=[f"x{i}" for i in cut], outputCols=[f"y{i}" for i in cut]).transform(plain)
    bins = [(F.col(f"y{i}") if i in cut else F.lit(0)).cast("tinyint").alias(f"b{i}") for i in range(width)]
    return plain.select(F.col("label").cast("int").alias("label"), *bins).groupBy("label", *[f"b{i}" for i in range(width)]).agg(F.count("*").alias("rows"))


def _bins(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    return np.stack([batch.column(f"b{i}").to_numpy() for i in range(width)], 1) if width else np.zeros((batch.num_rows, 0), np.int8)


def poisson(u: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Poisson numbers of whole means, by inversion of the uniform numbers in each row of ``u``."""
    out = np.empty(u.shape, np.int64)
    for mean in np.unique(means).tolist():
        reach = 12 * mean**0.5 + 24
        k = np.arange(max(0, int(mean - reach)), int(mean + reach) + 1)
        logs = np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(k[1:]))])
        weight = np.exp(logs - logs.max())
        at = means == mean
        out[at] = k[np.minimum(np.searchsorted(np.cumsum(weight) / weight.sum(), u[at], "right"), len(k) - 1)]
    return out


def _bags(bins: np.ndarray, labels: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often each tree (a column) takes each cell (a row)."""
    cell = _mixed(labels.astype(U64) + U64(1))
    for column in bins.T:
        cell = _mixed(cell * _GOLDEN + column.astype(U64) + U64(1))
    return poisson((_mixed(cell[:, None] ^ keys[None]) >> U64(11)).astype(np.float64) / 2.0**53, rows)


def _chosen(heap: np.ndarray, keys: np.ndarray, width: int, take: int) -> np.ndarray:
    """The features that each node may be split by, drawn for its tree and its place in the tree."""
    node = _mixed(keys ^ (heap.astype(U64) * _GOLDEN))
    draws = _mixed(node[:, None] + np.arange(1, width + 1, dtype=U64)[None] * _GOLDEN)
    return np.sort(np.argsort(draws, 1, kind="stable")[:, :take], 1)


def _best_cuts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histograms (node, feature drawn, bin, class): the feature drawn with the greatest Gini gain, -1 if none gains, and its last bin to the left."""
    left = counts.cumsum(2)
    total = left[:, :, -1:]
    left = left[:, :, :-1]
    right = total - left
    n_left, n_right, n = (np.einsum("nfbc->nfb", x) for x in (left, right, total))
    squares = lambda x: np.einsum("nfbc,nfbc->nfb", x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = squares(left) / n_left + squares(right) / n_right - squares(total) / n
    gain = np.where((n_left > 0) & (n_right > 0), gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(1)
    found = gain[np.arange(len(counts)), best] > 1e-9 * n[:, 0, 0]
    return np.where(found, best // (BINS - 1), -1), best % (BINS - 1)


def grown_votes(
    bins: np.ndarray, labels: np.ndarray, weights: np.ndarray, asked: np.ndarray, heap: int, key: np.uint64, classes: int, take: int, max_depth: int
) -> np.ndarray:
    """The class shares, times ``VOTE``, that the tree below the node ``heap`` gives to each asked cell."""
    width = bins.shape[1]
    votes = np.zeros((len(asked), classes), np.int64)
    rows, at, questions, seen = np.arange(len(bins)), np.zeros(len(bins), np.int64), np.arange(len(asked)), np.zeros(len(asked), np.int64)
    nodes, depth = np.array([heap], np.int64), int(heap).bit_length() - 1
    step = max(1, SLOTS // (take * BINS * classes)) if take else 1
    while len(rows):
        totals = np.bincount(at * classes + labels[rows], weights[rows], len(nodes) * classes).reshape(-1, classes)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        mixed = np.flatnonzero((totals > 0).sum(1) > 1) if depth < max_depth and take else np.zeros(0, np.int64)
        for begin in range(0, len(mixed), step):
            part = mixed[begin : begin + step]
            place = np.full(len(nodes), -1)
            place[part] = np.arange(len(part))
            inside = np.flatnonzero(place[at] >= 0)
            local, r = place[at[inside]], rows[inside]
            drawn = _chosen(nodes[part], np.full(len(part), key), width, take)
            slot = ((local[:, None] * take + np.arange(take)) * BINS + bins[r[:, None], drawn[local]]) * classes + labels[r, None]
            counts = np.bincount(slot.ravel(), np.repeat(weights[r], take), len(part) * take * BINS * classes)
            best, cut[part] = _best_cuts(counts.reshape(len(part), take, BINS, classes))
            feature[part] = np.where(best >= 0, drawn[np.arange(len(part)), best], -1)
        leaf = feature < 0
        ends = leaf[seen]
        votes[questions[ends]] = np.rint(totals / totals.sum(1, keepdims=True) * VOTE).astype(np.int64)[seen[ends]]
        rank = np.cumsum(~leaf) - 1
        goes, asks = ~leaf[at], ~ends
        rows, at, questions, seen = rows[goes], at[goes], questions[asks], seen[asks]
        at = 2 * rank[at] + (bins[rows, feature[at]] > cut[at])
        seen = 2 * rank[seen] + (asked[questions, feature[seen]] > cut[seen])
        nodes = (2 * nodes[~leaf, None] + np.arange(2)).ravel()
        depth += 1
    return votes


class _Top:
    """The upper nodes of all trees, roots first; what lies below the nodes without a split is grown in tasks."""

    def __init__(self, trees: int):
        self.tree, self.heap = np.arange(trees), np.ones(trees, np.int64)
        self.feature, self.cut, self.left = np.full(trees, -1), np.zeros(trees, np.int64), np.zeros(trees, np.int64)

    def split(self, nodes: Sequence[int], features: Sequence[int], cuts: Sequence[int]) -> None:
        nodes = np.asarray(nodes, np.int64)
        self.feature[nodes], self.cut[nodes] = features, cuts
        self.left[nodes] = len(self.tree) + 2 * np.arange(len(nodes))
        more = lambda a, new: np.concatenate([a, new])
        self.heap = more(self.heap, (2 * self.heap[nodes, None] + np.arange(2)).ravel())
        self.tree = more(self.tree, np.repeat(self.tree[nodes], 2))
        blank = np.zeros(2 * len(nodes), np.int64)
        self.feature, self.cut, self.left = more(self.feature, blank - 1), more(self.cut, blank), more(self.left, blank)

    def places(self, bins: np.ndarray, rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The node without a split at which each row of ``bins`` arrives in each tree."""
        node, moving = trees.copy(), np.arange(len(trees))
        while len(moving := moving[self.feature[node[moving]] >= 0]):
            now = node[moving]
            node[moving] = self.left[now] + (bins[rows[moving], self.feature[now]] > self.cut[now])
        return node


def _taken(batch: pa.RecordBatch, width: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins and labels of a batch of cells, and (cell, tree, weight) wherever a tree takes one."""
    bins, labels = _bins(batch, width), batch.column("label").to_numpy()
    bags = _bags(bins, labels, batch.column("rows").to_numpy(), keys)
    rows, trees = np.nonzero(bags)
    return bins, labels, rows, trees, bags[rows, trees]


def _grow_top(cells: DataFrame, width: int, classes: int, take: int, keys: np.ndarray, max_depth: int, part_cells: int) -> _Top:
    """Split the nodes of more than ``part_cells`` cells, level by level; the driver holds these nodes alone."""
    top = _Top(len(keys))
    active = np.arange(len(keys)) if cells.count() > part_cells and take else np.zeros(0, np.int64)
    shape = (take, BINS, classes)
    slots = take * BINS * classes

    def split_some(nodes: np.ndarray) -> list:
        drawn = _chosen(top.heap[nodes], keys[top.tree[nodes]], width, take)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place = np.full(len(top.tree), -1)
            place[nodes] = np.arange(len(nodes))
            weight, number = np.zeros(len(nodes) * slots), np.zeros(len(nodes) * slots, np.int64)
            for batch in batches:
                bins, labels, rows, trees, bags = _taken(batch, width, keys)
                local = place[top.places(bins, rows, trees)]
                inside = local >= 0
                local, rows, bags = local[inside], rows[inside], bags[inside]
                for j in range(take):
                    slot = ((local * take + j) * BINS + bins[rows, drawn[local, j]]) * classes + labels[rows]
                    weight += np.bincount(slot, bags, len(weight))
                    number += np.bincount(slot, minlength=len(weight))
            at = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at // slots]), pa.array(at % slots), pa.array(weight[at].astype(np.int64)), pa.array(number[at])], ["node", "slot", "weight", "cells"])

        def choose(table: pa.Table) -> pa.Table:
            node, slot = table.column("node")[0].as_py(), table.column("slot").to_numpy()
            weight, number = (np.bincount(slot, table.column(c).to_numpy(), slots).reshape(1, *shape) for c in ("weight", "cells"))
            best, cut = _best_cuts(weight)
            sides = number[0, best[0]].sum(1)
            feature = drawn[np.searchsorted(nodes, node), best[0]] if best[0] >= 0 else -1
            found = [node, int(feature), int(cut[0]), int(sides[: cut[0] + 1].sum()), int(sides[cut[0] + 1 :].sum())]
            return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("node", "feature", "cut", "to_left", "to_right"), found)})

        counted = cells.mapInArrow(count, "node long, slot long, weight long, cells long")
        return counted.groupBy("node").applyInArrow(choose, "node long, feature long, cut long, to_left long, to_right long").collect()

    step = max(1, SLOTS // slots) if slots else 1
    depth = 0
    while len(active) and depth < max_depth:
        found = sorted(r for at in range(0, len(active), step) for r in split_some(active[at : at + step]))
        found = [r for r in found if r["feature"] >= 0]
        first = len(top.tree)
        top.split(*([r[c] for r in found] for c in ("node", "feature", "cut")))
        sizes = np.array([s for r in found for s in (r["to_left"], r["to_right"])], np.int64)
        active = first + np.flatnonzero(sizes > part_cells)
        depth += 1
    return top


def _parts(tests: DataFrame, top: _Top, width: int, trees: int, part_cells: int) -> np.ndarray:
    """In how many parts the cells to score of each node are dealt, so that none is large."""
    parts = np.ones(len(top.tree), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(len(top.tree), np.int64)
        for batch in batches:
            rows = np.arange(batch.num_rows).repeat(trees)
            number += np.bincount(top.places(_bins(batch, width), rows, np.tile(np.arange(trees), batch.num_rows)), minlength=len(number))
        at = np.flatnonzero(number)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(number[at])], ["node", "cells"])

    if tests.count() > part_cells:
        for r in tests.mapInArrow(count, "node long, cells long").groupBy("node").agg(F.sum("cells").alias("n")).collect():
            parts[r["node"]] = -(-r["n"] // part_cells)
    return parts


def forest_scores(
    train: DataFrame, test: DataFrame, width: int, classes: int, trees: int, max_depth: int, seed: int = 42, part_cells: int = PART_CELLS
) -> DataFrame:
    """(label, rows, prediction, score) of the counted cells of ``test``; ``score`` is the mean share of class 1 over the trees.

    Both tables have ``features``, a vector of ``width`` numbers, and ``label``, a whole number below ``classes``. Every node is
    split by the best of sqrt(width) features drawn for it, until it is pure, gains nothing or lies at ``max_depth``.
    """
    x = vector_to_array("features")
    bounds = thresholds(train.select(*[x[i].alias(f"x{i}") for i in range(width)]), [f"x{i}" for i in range(width)])
    cells = materialise(_binned(train, width, bounds), "cells")
    tests = materialise(_binned(test, width, bounds).withColumn("cell", F.monotonically_increasing_id()), "tests")
    if cells.isEmpty():
        raise ValueError("no rows to train on")
    keys, take, names = _tree_keys(trees, seed), int(np.ceil(np.sqrt(width))), [f"b{i}" for i in range(width)]
    top = _grow_top(cells, width, classes, take, keys, max_depth, part_cells)
    parts = _parts(tests, top, width, trees, part_cells)
    dealt = f"node long, part long, cell long, label int, weight long, {', '.join(f'{b} tinyint' for b in names)}"

    def rows_of(node, part, cell, label, weight, bins) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        given = [pa.array(v, t) for v, t in zip((node, part, cell, label, weight), types)]
        return pa.RecordBatch.from_arrays([*given, *[pa.array(b, pa.int8()) for b in bins.T]], ["node", "part", "cell", "label", "weight", *names])

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, labels, rows, at, bags = _taken(batch, width, keys)
            node = top.places(bins, rows, at)
            copies = parts[node]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            rows, node, bags = (np.repeat(v, copies) for v in (rows, node, bags))
            yield rows_of(node, part, np.full(len(rows), -1), labels[rows], bags, bins[rows])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, rows = _bins(batch, width), np.arange(batch.num_rows).repeat(trees)
            node = top.places(bins, rows, np.tile(np.arange(trees), batch.num_rows))
            cell = batch.column("cell").to_numpy()[rows]
            part = (_mixed(cell.astype(U64) + U64(1)) % parts[node].astype(U64)).astype(np.int64)
            yield rows_of(node, part, cell, np.zeros(len(rows), np.int32), np.zeros(len(rows), np.int64), bins[rows])

    def grow(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        bins, weight, cell = _bins(table, width), table.column("weight").to_numpy(), table.column("cell").to_numpy()
        known, asked = np.flatnonzero(cell < 0), np.flatnonzero(cell >= 0)
        labels = table.column("label").to_numpy().astype(np.int64)[known]
        votes = grown_votes(bins[known], labels, weight[known].astype(np.float64), bins[asked], int(top.heap[node]), keys[top.tree[node]], classes, take, max_depth)
        rows, kinds = np.nonzero(votes)
        return pa.table({"cell": cell[asked][rows], "class": kinds, "votes": votes[rows, kinds]})

    both = cells.mapInArrow(learned, dealt).unionByName(tests.mapInArrow(scored, dealt))
    votes = both.groupBy("node", "part").applyInArrow(grow, "cell long, class long, votes long")
    by_class = votes.groupBy("cell", "class").agg(F.sum("votes").alias("votes"))
    first = F.max_by("class", F.struct("votes", -F.col("class"))).cast("double")
    share = F.sum(F.when(F.col("class") == 1, F.col("votes")).otherwise(0)) / F.lit(float(trees * VOTE))
    won = by_class.groupBy("cell").agg(first.alias("prediction"), share.alias("score"))
    return tests.select("cell", F.col("label").cast("double").alias("label"), "rows").join(won, "cell", "left").select(
        "label", "rows", F.coalesce("prediction", F.lit(0.0)).alias("prediction"), F.coalesce("score", F.lit(0.0)).alias("score")
    )
