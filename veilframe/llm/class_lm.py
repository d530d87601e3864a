"""A class-based trigram language model whose classes come from exchange clustering.

Every word has a unit: the most frequent words each their own, all others that of their last three bytes, so that the number of
units, and with it all that is broadcast, has a fixed bound while every token of the corpus counts. The exchange step moves
one unit after another to the class that raises the likelihood of the class bigrams most. Units are dealt to parts, which
move their own units against the class counts of the round's start; what a round did is measured over all counts, and the best
round stays.

A word then costs p(class | the two classes before) * p(word | class). Class transitions are counted over all training texts
and smoothed by Witten and Bell's interpolation; emissions use each word's exact count, and Good and Turing's share of words
seen once is kept for the unseen word of each class. Words beyond the ``COUNTED`` most frequent are looked up by a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GOLDEN, LOWER, U64, arrow_map, mixed, pick, slices, word_hashes, words
from veilframe.operators.lookup import lookup_join
from veilframe.session import materialise

NAMED, SUFFIXES = 1 << 15, 1 << 13
BOUNDARY = NAMED + SUFFIXES  # the unit before the first and after the last word of a text
UNITS = BOUNDARY + 1
COUNTED = 1 << 20
#: Classes, the last of which holds the boundary alone.
CLASSES = 128
ROUNDS = 4
#: Pairs of a part, in both directions, on average; and words that a task counts before it hands on their counts.
PART_PAIRS = 1 << 18
FLUSH = 1 << 20


@dataclass
class ClassModel:
    """Sorted hashes of the words with units of their own; sorted hashes and counts of the words that are counted in tasks; the
    class of each unit; log10 of class transitions and of what an emission has besides the word's count; ``outside``
    (w, n) are the counts of all other words. ``tokens``, ``types`` and ``ends`` include the end of each text."""

    named: np.ndarray
    counted: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    transitions: np.ndarray
    of_named: np.ndarray
    of_rare: np.ndarray
    of_unseen: np.ndarray
    tokens: int
    types: int
    ends: int
    outside: DataFrame
    rounds: list[float] = field(default_factory=list)  # log-likelihood of the class bigrams before and after each round


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key in a sorted table, -1 where it is not."""
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def units_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, named: np.ndarray) -> np.ndarray:
    """The unit of each word."""
    tail = np.zeros(len(starts), U64)
    for k in (1, 2, 3):
        inside = ends - k >= starts
        tail[inside] = tail[inside] << U64(8) | LOWER[data[ends[inside] - k]].astype(U64) + U64(1)
    suffix = (mixed(tail * U64(GOLDEN)) % U64(SUFFIXES)).astype(np.int64) + NAMED
    own = _find(named, hashes)
    return np.where(own >= 0, own, suffix)


def bounded(values: np.ndarray, counts: np.ndarray, boundary: int) -> np.ndarray:
    """Texts end to end with the boundary before, between and after them."""
    return np.insert(values, np.concatenate([[0], np.cumsum(counts)]), boundary)


def word_counts(docs: DataFrame) -> DataFrame:
    """w (64-bit hash of the word, A-Z lower-cased) and n, its occurrences in the texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, U64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["w", "n"])

        for _, data, offsets in slices(batches):
            starts, ends, _ = words(data, offsets)
            held.append(word_hashes(data, starts, ends))
            size += len(starts)
            if size >= FLUSH:
                yield flushed()
                size = 0
        yield flushed()

    return arrow_map(docs, make, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def unit_pairs(docs: DataFrame, named) -> DataFrame:
    """a, b, n: how often unit b follows unit a, over all texts with their boundaries."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.int64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts, pa.int64())], ["pair", "n"])

        for rows, data, offsets in slices(batches):
            starts, ends, owner = words(data, offsets)
            units = units_of(data, starts, ends, word_hashes(data, starts, ends), named.value)
            line = bounded(units, np.bincount(owner, minlength=rows.num_rows), BOUNDARY)
            held.append(line[:-1] * UNITS + line[1:])
            size += len(line)
            if size >= FLUSH:
                yield flushed()
                size = 0
        yield flushed()

    pairs = arrow_map(docs, make, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.select(F.floor(F.col("pair") / UNITS).cast("int").alias("a"), F.pmod("pair", F.lit(UNITS)).cast("int").alias("b"), "n")


_PARTS = "part long, unit binary, other binary, back binary, n binary"


def unit_parts(pairs: DataFrame, n_pairs: int) -> DataFrame:
    """The pairs of each part's units in both directions, a row of packed arrays for each part; stored."""
    parts = max(32, -(-2 * n_pairs // PART_PAIRS))
    both = pairs.select(F.explode(F.array(F.struct("a", F.col("b").alias("o"), F.lit(False).alias("back"), "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("o"), F.lit(True).alias("back"), "n"))).alias("e"))
    rows = both.select(F.pmod(F.xxhash64("e.a"), F.lit(parts)).alias("part"), "e.a", "e.o", "e.back", "e.n")

    def pack(table: pa.Table) -> pa.Table:
        column = lambda name, kind: table[name].combine_chunks().to_numpy(zero_copy_only=False).astype(kind).tobytes()
        blobs = [pa.array([column(c, k)], pa.binary()) for c, k in (("a", np.int32), ("o", np.int32), ("back", bool), ("n", np.int64))]
        return pa.table([table["part"].combine_chunks().slice(0, 1), *blobs], names=["part", "unit", "other", "back", "n"])

    return materialise(rows.groupBy("part").applyInArrow(pack, _PARTS), "unit-parts")


def _part_arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for k in range(batch.num_rows):
        yield tuple(np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in enumerate((np.int32, np.int32, bool, np.int64), 1))


def class_matrix(parts: DataFrame, classes: np.ndarray) -> np.ndarray:
    """How often a class follows another, from the pairs of all parts."""
    known = parts.sparkSession.sparkContext.broadcast(classes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for unit, other, back, n in _part_arrays(batch):
                cell = known.value[unit[~back]].astype(np.int64) * CLASSES + known.value[other[~back]]
                np.add.at(total, cell, n[~back])
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    got = arrow_map(parts, make, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CLASSES^2 rows at most
    out = np.zeros(CLASSES * CLASSES)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(CLASSES, CLASSES)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(matrix: np.ndarray) -> float:
    """The log-likelihood of the class bigrams but for what no exchange changes."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(1)).sum() - _xlogx(matrix.sum(0)).sum())


def exchange(units: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, classes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """New classes of ``units``, moved one after another, the most frequent first.

    ``after`` and ``before`` hold how often each class follows and precedes a unit, ``own`` how often the unit follows itself;
    ``matrix`` holds the class bigrams of all units and is moved along on a copy.
    """
    m, free = matrix.copy(), CLASSES - 1
    rows, cols, fm = m.sum(1), m.sum(0), _xlogx(m)
    fr, fc = _xlogx(rows), _xlogx(cols)
    out = classes[units].copy()
    for k in np.argsort(-before.sum(1), kind="stable"):
        s, p, self_, old = after[k].astype(float), before[k].astype(float), float(own[k]), int(out[k])
        if not s.any() and not p.any():
            continue
        s_all, p_all = s.sum(), p.sum()
        s[old] -= self_
        p[old] -= self_
        js, ps = np.flatnonzero(s), np.flatnonzero(p)

        def shift(to: int, sign: float) -> None:
            m[to, js] += sign * s[js]
            m[ps, to] += sign * p[ps]
            m[to, to] += sign * self_
            rows[to] += sign * s_all
            cols[to] += sign * p_all
            for line in ((to, js), (ps, to), (to, to)):
                fm[line] = _xlogx(np.maximum(m[line], 0))
            fr[to], fc[to] = _xlogx(rows[to]), _xlogx(cols[to])

        shift(old, -1)
        gain = (_xlogx(m[:free, js] + s[js]) - fm[:free, js]).sum(1)
        gain += (_xlogx(m[ps, :free] + p[ps, None]) - fm[ps, :free]).sum(0)
        mid, fmid = m.diagonal()[:free], fm.diagonal()[:free]
        gain += _xlogx(mid + s[:free] + p[:free] + self_) + fmid - _xlogx(mid + s[:free]) - _xlogx(mid + p[:free])
        gain -= _xlogx(rows[:free] + s_all) - fr[:free] + _xlogx(cols[:free] + p_all) - fc[:free]
        best = int(gain.argmax())
        out[k] = best if gain[best] > gain[old] + 1e-9 else old
        shift(int(out[k]), 1)
    return out


def exchanged(parts: DataFrame, classes: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """One round: every part moves its units."""
    known = parts.sparkSession.sparkContext.broadcast((classes, matrix))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, matrix = known.value
        for batch in batches:
            for unit, other, back, n in _part_arrays(batch):
                free = unit != BOUNDARY
                units, which = np.unique(unit[free], return_inverse=True)
                cell = which * CLASSES + classes[other[free]]
                sides = [
                    np.bincount(cell[side], n[free][side], len(units) * CLASSES).reshape(-1, CLASSES) for side in (~back[free], back[free])
                ]
                loop = (unit[free] == other[free]) & ~back[free]
                own = np.bincount(which[loop], n[free][loop], len(units))
                moved = exchange(units, *sides, own, classes, matrix)
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(moved, pa.int32())], ["unit", "class"])

    got = arrow_map(parts, make, "unit int, class int").toArrow()  # a row for each unit
    out = classes.copy()
    out[got["unit"].to_numpy()] = got["class"].to_numpy()
    return out


def class_trigrams(docs: DataFrame, named, classes: np.ndarray) -> np.ndarray:
    """How often each class follows two others, over all texts with boundaries."""
    known = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(CLASSES**3, np.int64), [], 0

        def add() -> None:
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=CLASSES**3)
                held.clear()

        for rows, data, offsets in slices(batches):
            starts, ends, owner = words(data, offsets)
            units = units_of(data, starts, ends, word_hashes(data, starts, ends), named.value)
            held.append(trigram_cells(known.value[units].astype(np.int64), np.bincount(owner, minlength=rows.num_rows)))
            size += len(held[-1])
            if size >= FLUSH:
                add()
                size = 0
        add()
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells], pa.int64())], ["cell", "n"])

    got = arrow_map(docs, make, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CLASSES^3 rows at most
    out = np.zeros(CLASSES**3)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape((CLASSES,) * 3)


def trigram_cells(of_words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word and each text's end the number of its class triple; before a text there are boundaries."""
    last = CLASSES - 1
    line = bounded(of_words, counts, last)
    one = line[:-1]
    two = np.concatenate([[last], line[:-2]])
    two[one == last] = last
    return (two * CLASSES + one) * CLASSES + line[1:]


def transition_logs(trigrams: np.ndarray) -> np.ndarray:
    """log10 of p(class | two classes before): trigrams over bigrams over single classes, each by Witten and Bell."""
    bigrams = trigrams.sum(0)
    single = bigrams.sum(0)
    p = (single + 1) / (single.sum() + CLASSES)
    for counts in (bigrams, trigrams):
        seen = (counts > 0).sum(-1, keepdims=True)
        total = counts.sum(-1, keepdims=True)
        p = np.where(total > 0, (counts + seen * p) / np.maximum(total + seen, 1), p)
    return np.log10(p).reshape(-1)


def fit(docs: DataFrame, text_col: str = "text") -> ClassModel:
    """The model of all texts of ``docs``; null and empty ones are an end alone. No texts at all give even odds."""
    spark = docs.sparkSession
    texts = pick(docs, text=text_col)
    counts = materialise(word_counts(texts), "word-counts")
    # Words by falling count: exact counts up to 4,095, then 64 steps for each doubling; some 8,000 rows at any input.
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(F.log2("n") * 64)).cast("long")
    steps = sorted((tuple(r) for r in counts.groupBy(step.alias("step")).agg(F.count("*"), F.sum("n")).collect()), reverse=True)

    def least(most: int) -> int:
        """The lowest step from 2 on down to which at most ``most`` words lie."""
        low, held = 1 << 62, 0
        for s, n_words, _ in steps:
            held += n_words
            if held > most or s < 2:
                break
            low = s
        return low

    def table(low: int) -> tuple[np.ndarray, np.ndarray]:
        got = counts.where(step >= low).toArrow()  # at most NAMED or COUNTED rows
        keys, n = (got[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("w", "n"))
        order = np.argsort(keys.view(U64))
        return keys.view(U64)[order], n[order]

    low = least(COUNTED)
    named, (counted, n_counted) = table(least(NAMED))[0], table(low)
    shared = spark.sparkContext.broadcast(named)

    pairs = materialise(unit_pairs(texts, shared), "unit-pairs")
    sizes = pairs.groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("pairs")).toArrow()  # a row for each unit
    of_unit = np.zeros(UNITS, np.int64)
    of_unit[sizes["b"].to_numpy()] = sizes["n"].to_numpy()
    parts = unit_parts(pairs, int(sizes["pairs"].to_numpy().sum()))

    # To begin with, units are dealt to classes by falling frequency.
    classes = np.zeros(UNITS, np.int16)
    classes[np.argsort(-of_unit[:BOUNDARY], kind="stable")] = np.arange(BOUNDARY) % (CLASSES - 1)
    classes[BOUNDARY] = CLASSES - 1
    matrix = class_matrix(parts, classes)
    rounds = [likelihood(matrix)]
    for _ in range(ROUNDS):
        moved = exchanged(parts, classes, matrix)
        after = class_matrix(parts, moved)
        rounds.append(likelihood(after))
        if rounds[-1] <= rounds[-2]:
            break
        classes, matrix = moved, after

    of_class = np.bincount(classes, of_unit, CLASSES)
    rare_of_class = np.bincount(classes[NAMED:BOUNDARY], of_unit[NAMED:BOUNDARY], CLASSES)
    # Units that never occurred go with the class of most rare words.
    classes[np.flatnonzero(of_unit[:BOUNDARY] == 0)] = rare_of_class[:-1].argmax()
    once = next((n for s, n, _ in steps if s == 1), 0)
    unseen = once / (rare_of_class.sum() + 1)
    n_words, n_types = sum(r[2] for r in steps), sum(r[1] for r in steps)
    ends = int(of_unit[BOUNDARY])
    return ClassModel(
        named=named,
        counted=counted,
        counts=n_counted,
        classes=classes,
        transitions=transition_logs(class_trigrams(texts, shared, classes)),
        of_named=-np.log10(of_class + 1),
        of_rare=np.log10(1 - unseen) - np.log10(of_class + 1),
        of_unseen=np.log10(unseen * rare_of_class + 1) - np.log10(of_class + 1),
        tokens=n_words + ends,
        types=n_types + (ends > 0),
        ends=ends,
        outside=counts.where(step < low),
        rounds=rounds,
    )


_SCORES = "doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<w: long, occurrences: long, unseen: double>>"


def score(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and the text's end; a null or empty text is its end alone. ``base_score``
    sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over the tokens, with their counts c in training; ``score`` is the model's
    log10 probability. Null ids and rows that repeat are rows of their own. Other columns play no part. An empty table gives
    an empty result. Counts of words that are not among the most frequent come by a join on the word.
    """
    arrays = (model.named, model.counted, model.counts, model.classes, model.transitions, model.of_named, model.of_rare, model.of_unseen)
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    n_ends = model.ends

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named, counted, counts, classes, transitions, of_named, of_rare, of_unseen = shared.value
        for rows, data, offsets in slices(batches):
            starts, ends, owner = words(data, offsets)
            hashes = word_hashes(data, starts, ends)
            units = units_of(data, starts, ends, hashes, named)
            of, n, each = classes[units].astype(np.int64), rows.num_rows, np.bincount(owner, minlength=rows.num_rows)
            steps = transitions[trigram_cells(of, each)]
            text_of_step = np.repeat(np.arange(n), each + 1)
            # What lies between the last text's end and nothing is no step: the line has one step for each word and end.
            total = np.bincount(text_of_step, steps, n)
            at = _find(counted, hashes)
            held = at >= 0
            c = counts[np.maximum(at, 0)] if len(counts) else np.zeros(len(at), np.int64)
            emission = np.where(units < NAMED, of_named[of], of_rare[of]) + np.where(held, np.log10(np.maximum(c, 1)), 0.0)
            total += np.bincount(owner, emission, n)
            base = np.bincount(owner[held], np.log10(c[held] + 0.5), n) + np.log10(n_ends + 0.5)
            known = np.bincount(owner[held], minlength=n) + (n_ends > 0)
            # The other words, each once for a text: their counts are joined.
            away = np.flatnonzero(~held)
            away = away[np.lexsort((hashes[away], owner[away]))]
            new = np.ones(len(away), bool)
            new[1:] = (hashes[away][1:] != hashes[away][:-1]) | (owner[away][1:] != owner[away][:-1])
            first = away[new]
            times = np.diff(np.append(np.flatnonzero(new), len(away)))
            entries = pa.StructArray.from_arrays(
                [pa.array(hashes[first].view(np.int64)), pa.array(times, pa.int64()), pa.array((of_unseen - of_rare)[of[first]])], ["w", "occurrences", "unseen"]
            )
            spots = np.concatenate([[0], np.cumsum(np.bincount(owner[first], minlength=n))])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    *(pa.array(x, pa.int64()) for x in (each + 1, known)),
                    pa.array(base),
                    pa.array(total),
                    pa.ListArray.from_arrays(pa.array(spots, pa.int32()), entries),
                ],
                ["doc_id", "n_tokens", "n_known", "base", "score", "rare"],
            )

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = materialise(arrow_map(rows, make, _SCORES).withColumn("_row", F.monotonically_increasing_id()), "scored")
    loose = scored.select("_row", F.inline("rare"))
    found = lookup_join(loose, model.outside, "w")
    many, seen = F.col("occurrences"), F.col("n").isNotNull()
    added = found.groupBy("_row").agg(
        F.sum(F.when(seen, many).otherwise(0)).alias("_known"),
        F.sum(many * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("_base"),
        F.sum(many * F.when(seen, F.log10("n")).otherwise(F.col("unseen"))).alias("_score"),
    )
    more = lambda c: F.coalesce(c, F.lit(0))
    whole = F.log10(F.lit(model.tokens + 0.5 * (model.types + 1)))
    return scored.drop("rare").join(added, "_row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + more("_known")).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more("_base") - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") + more("_score")).alias("score"),
    )
