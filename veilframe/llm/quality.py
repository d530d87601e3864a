"""Document quality by histogram gradient-boosted trees over statistics of the text.

Trees are grown on the driver from a bounded sample of labelled documents: features are cut into quantile bins, and a
level's splits come from histograms of gradients over them. The model is flattened into arrays, of which the scoring tasks
walk all trees for all documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import BYTE_CODES, arrow_map, gram_hashes, pick, share, slices, span_hashes, word_hashes, words

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.15, 20, 1.0

FEATURES = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "log_longest_word", "upper", "digit", "punctuation", "exclamation",
    "bracket", "bar", "other_symbol", "non_ascii", "stop_per_word", "comma_per_word", "lines_per_word", "distinct_words", "top_word",
    "repeated_neighbour", "distinct_pairs", "top_pair", "distinct_lines", "upper_words", "capital_words", "words_with_symbol_end",
    "short_words",
)

_CLASSES = np.full(256, 9, np.uint8)
for _n, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".?", b",;:'\"-", b"!", b"<>{}[]()", b"|", b"#$%&*+/=@\\^_`~", bytes(range(128, 256)))
):
    _CLASSES[list(_bytes)] = _n


def _runs(owner: np.ndarray, keys: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: how many keys, how many distinct ones, how often the most frequent one."""
    total = np.bincount(owner, minlength=texts)
    distinct, top, at = np.zeros(texts), np.zeros(texts), np.concatenate([[0], np.cumsum(total)])
    for t in np.flatnonzero(total):
        part = np.sort(keys[at[t] : at[t + 1]])
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        distinct[t], top[t] = len(edges) - 1, np.diff(edges).max()
    return total, distinct, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; a text without words has zeros where nothing can be counted."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    kind = np.zeros((texts, 10))
    owner = np.repeat(np.arange(texts), size)
    for n in range(10):
        kind[:, n] = np.bincount(owner[_CLASSES[data] == n], minlength=texts)
    starts, ends, of = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    length = (ends - starts).astype(float)
    count, distinct, top = _runs(of, hashes, texts)
    per = lambda x, n: x / np.maximum(n, 1)
    mean = per(np.bincount(of, length, texts), count)
    variance = per(np.bincount(of, length**2, texts), count) - mean**2
    longest = np.zeros(texts)
    np.maximum.at(longest, of, length)
    same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    pair = of[1:] == of[:-1]
    pairs, distinct_pairs, top_pair = _runs(of[:-1][pair], gram_hashes(hashes, 2)[pair], texts)
    # Lines: ends at each newline and at each text's end.
    newline = np.flatnonzero(data == 10)
    line_owner = np.searchsorted(offsets, newline, "right") - 1
    stops = np.sort(np.concatenate([newline, offsets[1:]]))
    begins = np.concatenate([[0], stops[:-1]])
    line_of = np.minimum(np.searchsorted(offsets, stops, "left") - 1, texts - 1)
    filled = stops - begins > 1
    line_hash = span_hashes(BYTE_CODES[data], np.minimum(begins + (data[np.minimum(begins, max(len(data) - 1, 0))] == 10 if len(data) else 0), stops), stops)
    lines, distinct_lines, _ = _runs(line_of[filled], line_hash[filled], texts)
    first, last = (_CLASSES[data[starts]], _CLASSES[data[ends - 1]]) if len(starts) else (np.zeros(0), np.zeros(0))
    upper_in = np.concatenate([[0], np.cumsum(_CLASSES[data] == 0)])
    by_word = lambda mask: per(np.bincount(of[mask], minlength=texts), count)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(variance, 0)), np.log1p(longest), per(kind[:, 0], size), per(kind[:, 1], size),
            per(kind[:, 2] + kind[:, 3], size), per(kind[:, 4], count), per(kind[:, 5], count), per(kind[:, 6], count), per(kind[:, 7], count),
            per(kind[:, 8], size), per(kind[:, 2], count), per(kind[:, 3], count), per(np.bincount(line_owner, minlength=texts), count),
            per(distinct, count), per(top, count), per(np.bincount(of[1:][same], minlength=texts), count), per(distinct_pairs, pairs),
            per(top_pair, pairs), per(distinct_lines, lines), by_word(upper_in[ends] - upper_in[starts] >= np.maximum(2, 0.6 * length)),
            by_word(first == 0), by_word((last >= 4) & (last <= 7)), by_word(length <= 3),
        ]
    )


@dataclass
class Model:
    """Trees as arrays of (tree, node): the feature, the threshold, and at the last level the value."""

    prior: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        if len(self.feature) and len(x):
            node = np.zeros((len(self.feature), len(x)), np.int64)
            tree, row = np.arange(len(self.feature))[:, None], np.arange(len(x))[None, :]
            depth = (self.feature.shape[1] + 1).bit_length() - 1
            for _ in range(depth):
                right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            total += self.value[tree, node - self.feature.shape[1]].sum(0)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees for the labels 0 and 1; with one label only, or none, the prior alone."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999)
    prior = float(np.log(share / (1 - share)))
    if len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return Model(prior, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    total, forest = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)  # within the level
        for level in range(DEPTH):
            n = 2**level
            best = np.full(n, 1e-6)
            cut = np.full(n, -1)
            chosen = np.zeros(n, np.int64)
            for f in range(x.shape[1]):
                spot = node * BINS + binned[:, f]
                g, h, c = (np.bincount(spot, w, n * BINS).reshape(n, BINS).cumsum(1) for w in (gradient, weight, None))
                gain = lambda a, b: a * a / (b + RIDGE)
                better = gain(g, h) + gain(g[:, -1:] - g, h[:, -1:] - h) - gain(g[:, -1:], h[:, -1:])
                better[(c < LEAST_ROWS) | (c[:, -1:] - c < LEAST_ROWS)] = -1
                at = better.argmax(1)
                gains = better[np.arange(n), at]
                take = gains > best
                best[take], cut[take], chosen[take] = gains[take], at[take], f
            for k in np.flatnonzero(cut >= 0):
                feature[n - 1 + k], threshold[n - 1 + k] = chosen[k], edges[chosen[k]][cut[k]]
            node = 2 * node + (x[np.arange(len(y)), feature[n - 1 + node]] > threshold[n - 1 + node])
        value = -RATE * np.bincount(node, gradient, leaves) / (np.bincount(node, weight, leaves) + RIDGE)
        total += value[node]
        forest.append((feature, threshold, value))
    return Model(prior, *(np.array([tree[i] for tree in forest]) for i in range(3)))


def _statistics_of(docs: DataFrame) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            x = statistics(data, offsets)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], flat], ["doc_id", "label", "text_hash", "x"])

    rows = docs.select("doc_id", "label", F.xxhash64("text").alias("text_hash"), "text")
    return arrow_map(rows, make, "doc_id long, label int, text_hash long, x array<double>")


def labelled_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, label, x: a row for each id of ``known`` that ``docs`` has, however often it repeats there."""
    # ``known`` is bounded by a parameter, hence the broadcast; what leaves a task is a row for each of its ids.
    rows = _statistics_of(docs.join(F.broadcast(known), "doc_id"))
    return rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("x", "text_hash").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> Model:
    """A model from at most ``sample_rows`` labelled documents whose crc32(id) mod ``held_out_of`` is not 0.

    The sample is the documents whose hashed ids come first, the same at every run; of very many labels only about four times
    as many are looked at, chosen by hash as well. Where labels of an id disagree the lower
    one counts; null labels and ids do not. Of rows that repeat an id the one whose text has the smallest hash counts.
    """
    known = (
        pick(share(labels, 4 * sample_rows, "doc_id"), doc_id="doc_id", label=label_col)
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of != 0)
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = labelled_rows(docs, known).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, len(FEATURES))
    order = np.lexsort([*x.T[::-1], rows["doc_id"].to_numpy()])
    return train(x[order], rows["label"].to_numpy()[order].astype(float))


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, held_out_of: int = 5
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The score is the chance of label 1 given the text alone; an empty or null text has the score of zero statistics. A null id
    is not held out. Rows that repeat are scored alike. Other columns play no part. Without usable labels every score is the
    labels' share of 1, or a half. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    model = fit(docs, labels, held_out_of)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == 0, F.lit(False))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            score = model.scores(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return arrow_map(docs.select("doc_id", held.alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns, in one scan and no shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, text_col):
            yield rows.filter(pa.array(model.scores(statistics(data, offsets)) >= threshold))

    return docs.mapInArrow(make, docs.schema)
