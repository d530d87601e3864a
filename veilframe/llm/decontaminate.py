"""Benchmark items in documents by greedy string tiling.

An item is found in a document if tiles cover enough of its tokens: again and again the longest run of tokens that is not yet
marked in either text is marked in both, until no run of ``SEED`` tokens is left. Tiles may lie in any order, so passages
whose parts were moved are found. Runs of a length are compared by rolling Karp-Rabin hashes.

Only tokens in runs that the benchmark has too can be in a tile. Documents are reduced to those tokens in the scan, by a bit
set of fixed size; the rest is equi-joins on the seeds' hashes. What the seeds of a pair cover bounds what tiles can cover,
and pairs under the threshold are not tiled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, arrow_map, gram_hashes, may_hold, membership, pick, powers, ragged, slices, word_hashes, words
from veilframe.session import materialise

SEED = 3
COVERAGE = 0.5

#: Tokens are runs of ASCII letters and digits and of characters beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (A-Z lower-cased; never 0) and the texts they are in."""
    starts, ends, owner = words(data, offsets, BETWEEN)
    return np.maximum(word_hashes(data, starts, ends), U64(1)), owner


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(position in item, position in text, length) of greedy string tiling; the token 0 matches nothing."""
    used = [item == 0, text == 0]
    sums = []
    for x in (item, text):
        up, _ = powers(len(x) + 1)
        # total[i + n] - total[i] * base^n is the hash of n tokens from i
        total = np.zeros(len(x) + 1, U64)
        acc, base = U64(0), up[1] if len(up) > 1 else U64(1)
        with np.errstate(over="ignore"):
            for k, v in enumerate(x.tolist()):
                acc = acc * base + U64(v)
                total[k + 1] = acc
        sums.append((total, up))

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        total, up = sums[side]
        marked = np.concatenate([[0], np.cumsum(used[side])])
        at = np.flatnonzero(marked[n:] == marked[:-n]) if len(marked) > n else np.zeros(0, np.int64)
        return at, total[at + n] - total[at] * up[n] if len(at) else np.zeros(0, U64)

    def common(n: int) -> bool:
        return bool(np.isin(windows(0, n)[1], windows(1, n)[1]).any())

    out, high = [], min(len(item), len(text))
    while high >= least and common(least):
        low = least  # the longest n with a common run: if n has one, so has every smaller n
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        at, left = windows(0, low)
        there, right = windows(1, low)
        order = np.argsort(right, kind="stable")
        first, last = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
        before = len(out)
        for k in np.flatnonzero(first < last).tolist():
            i = int(at[k])
            if used[0][i : i + low].any():
                continue
            for j in there[order[first[k] : last[k]]].tolist():
                if not used[1][j : j + low].any() and np.array_equal(item[i : i + low], text[j : j + low]):
                    used[0][i : i + low] = used[1][j : j + low] = True
                    out.append((i, j, low))
                    break
        high = low if len(out) > before else low - 1
    return out


def item_table(benchmark: DataFrame) -> DataFrame:
    """item_id, tokens, seeds (hashes of the runs of ``SEED`` tokens, by position)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            codes, owner = tokens(data, offsets)
            counts = np.bincount(owner, minlength=rows.num_rows)
            parts = np.split(codes, np.cumsum(counts)[:-1])
            seeds = [gram_hashes(p, SEED) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    ragged(codes.view(np.int64), counts, pa.int64()),
                    ragged(np.concatenate(seeds).view(np.int64), np.array([len(s) for s in seeds]), pa.int64()),
                ],
                ["item_id", "tokens", "seeds"],
            )

    return arrow_map(benchmark, make, "item_id long, tokens array<bigint>, seeds array<bigint>")


def covered_tokens(docs: DataFrame, held, least: int) -> DataFrame:
    """doc_id, text_hash, tokens (those in runs that the bit set may hold, runs parted by 0), seeds: documents with ``least`` such tokens."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            codes, owner = tokens(data, offsets)
            grams = gram_hashes(codes, SEED)
            hit = may_hold(held.value, grams) & (owner[: len(grams)] == owner[SEED - 1 :]) if len(grams) else np.zeros(0, bool)
            inside = np.zeros(len(codes), bool)
            for k in range(SEED):
                inside[k : k + len(hit)] |= hit
            enough = np.bincount(owner[inside], minlength=rows.num_rows) >= least
            inside &= enough[owner] if len(owner) else inside
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            fresh = np.diff(at, prepend=-2) > 1
            of = owner[at]
            where = np.flatnonzero(fresh)
            spread = np.insert(codes[at], where, U64(0))
            spread_of = np.insert(of, where, of[where])
            taken = np.flatnonzero(np.bincount(spread_of, minlength=rows.num_rows))
            counts = np.bincount(spread_of, minlength=rows.num_rows)[taken]
            hits = np.flatnonzero(hit)
            hits = hits[enough[owner[hits]]]
            seeds = [np.unique(p) for p in np.split(grams[hits], np.cumsum(np.bincount(owner[hits], minlength=rows.num_rows))[:-1])]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(taken)),
                    rows.column(1).take(pa.array(taken)),
                    ragged(spread.view(np.int64), counts, pa.int64()),
                    ragged(np.concatenate(seeds).view(np.int64), np.array([len(seeds[t]) for t in taken]), pa.int64()),
                ],
                ["doc_id", "text_hash", "tokens", "seeds"],
            )

    return arrow_map(docs, make, "doc_id long, text_hash long, tokens array<bigint>, seeds array<bigint>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """doc_id, item_id, item_tokens, matched_tokens, coverage, n_tiles, reordered, text_hash: a row for each item found in a document.

    An item is found if tiles cover ``coverage`` of its tokens or more; ``reordered`` says whether tiles come in another order
    than in the item. Tokens ignore the case of A-Z and everything that is no letter or digit. Null and empty texts, and items
    of fewer than three tokens, match nothing. Rows that repeat give one row; rows without an id are one document without an
    id for each distinct content. Other columns play no part. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    items = pick(benchmark, item_id=item_col, text=item_text_col).withColumn("item_id", F.col("item_id").cast("long"))
    items = materialise(item_table(items).where(F.size("seeds") > 0).distinct().withColumn("item", F.xxhash64("item_id", "tokens")), "items")
    held = membership(items.select(F.explode("seeds").alias("seed")), "seed")
    shortest = items.agg(F.min(F.size("tokens"))).first()[0] or 1
    found = materialise(covered_tokens(docs, held, math.ceil(coverage * shortest)).distinct().withColumn("row", F.xxhash64("doc_id", "text_hash")), "covered")

    seeds = items.select("item", F.size("tokens").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    touched = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(p, p + SEED - 1)))))
    pairs = (
        found.select("row", F.explode("seeds").alias("seed"))
        .join(seeds, "seed")
        .groupBy("row", "item", "n")
        .agg(F.collect_set("at").alias("at"))
        .where(touched(F.col("at")) >= coverage * F.col("n"))
        .select("row", "item")
    )
    both = pairs.join(found.select("row", "doc_id", "text_hash", F.col("tokens").alias("text")), "row").join(items.select("item", "item_id", "tokens"), "item")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                text, item = (batch.column(c)[row].values.to_numpy().view(U64) for c in (3, 4))
                placed = sorted(tiles(item, text))
                matched = sum(n for _, _, n in placed)
                if matched >= coverage * len(item):
                    order = [j for _, j, _ in placed]
                    ids = [batch.column(c)[row].as_py() for c in range(3)]
                    out.append((*ids[:2], len(item), matched, matched / len(item), len(placed), order != sorted(order), ids[2]))
            names = ["doc_id", "item_id", "item_tokens", "matched_tokens", "coverage", "n_tiles", "reordered", "text_hash"]
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    schema = "doc_id long, item_id long, item_tokens long, matched_tokens long, coverage double, n_tiles long, reordered boolean, text_hash long"
    return arrow_map(both.select("doc_id", "item_id", "text_hash", "text", "tokens"), tile, schema).distinct()
