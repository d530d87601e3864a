"""Nearest neighbours by largest inner product: a block matrix join with int8 products and exact recomputation.

Queries and candidates are dealt into stripes by their ids; a task takes one stripe of each and never holds more. It rounds
vectors to int8 steps, multiplies tiles of them, and bounds each product from both sides by the rounding errors. Pairs whose
upper bound reaches the k-th lower bound of their query are computed again in double precision and go through a heap of the
k best. The heaps of a query's tasks are merged at the end. Nothing is approximate in the result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_STRIPE, CANDIDATE_STRIPE = 2048, 8192
TILE = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole steps in -127..127, the step of each vector, the lengths of vector, rounded vector and error, and an exponent.

    Each vector is divided by two to its exponent first, so that its largest component lies between a half and one and no
    square leaves the range of doubles. Step and lengths are those of the divided vector.
    """
    exponent = np.frexp(np.abs(x).max(1))[1]
    x = np.ldexp(x, -exponent[:, None])
    step = np.abs(x).max(1) / 127
    step = np.where(step > 0, step, 1.0)
    steps = np.rint(x / step[:, None]).astype(np.int8)
    rounded = steps * step[:, None]
    length = lambda v: np.sqrt((v * v).sum(1)) * (1 + 1e-9)
    return steps, step, length(x), length(rounded), length(x - rounded), exponent


def bounds(near: np.ndarray, slack: np.ndarray, left: np.ndarray, right: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product in double precision, for products and slacks of vectors divided by 2 to their exponents.

    Products that underflow are off by less than ``dimension`` of the smallest doubles. A sum that may overflow on its way is
    not bounded at all, so its pair is kept and computed.
    """
    low, high = near - slack, near + slack
    if max(np.abs(left).max(), np.abs(right).max()) < 400:  # both factors and all products are ordinary numbers
        scale = np.exp2(left)[:, None] * np.exp2(right)[None, :]
        return low * scale, high * scale
    exponent = left[:, None] + right[None, :]
    tiny = 2 * dimension * np.nextafter(0, 1)
    with np.errstate(over="ignore", under="ignore"):
        low, high = np.ldexp(low, exponent) - tiny, np.ldexp(high, exponent) + tiny
    wild = exponent + np.log2(dimension) >= 1022
    return np.where(wild, -np.inf, low), np.where(wild, np.inf, high)


def best_of_stripes(query_ids, queries, candidate_ids, candidates, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (score, -id) among the candidates with another id, as a heap."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64  # whole numbers stay exact
    qs, q_step, q_len, _, q_err, q_exp = quantised(queries)
    cs, c_step, c_len, c_rounded, c_err, c_exp = quantised(candidates)
    floor = np.full(len(query_ids), -np.inf)
    for a in range(0, len(query_ids), TILE):
        rows = slice(a, a + TILE)
        left = qs[rows].astype(exact)
        for b in range(0, len(candidate_ids), TILE):
            cols = slice(b, b + TILE)
            near = (left @ cs[cols].astype(exact).T).astype(np.float64)
            near *= q_step[rows, None]
            near *= c_step[None, cols]
            slack = np.outer(q_err[rows], c_rounded[cols]) + np.outer(q_len[rows], c_err[cols] + 1e-12 * c_len[cols])
            own = query_ids[rows, None] == candidate_ids[None, cols]
            low, high = bounds(near, slack, q_exp[rows], c_exp[cols], queries.shape[1])
            low = np.where(own, -np.inf, low)
            if low.shape[1] > k:
                reach = np.maximum(floor[rows], np.partition(low, -k, axis=1)[:, -k])
            else:
                reach = floor[rows]
            i, j = np.nonzero((high >= reach[:, None]) & ~own)
            score = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for d in range(queries.shape[1]):  # in the order of the components, in double precision
                    score += queries[a + i, d] * candidates[b + j, d]
            score = np.where(np.isnan(score), -np.inf, score)
            for q, value, c in zip((a + i).tolist(), score.tolist(), candidate_ids[b + j].tolist()):
                heap = heaps[q]
                if len(heap) < k:
                    heapq.heappush(heap, (value, -c))
                elif (value, -c) > heap[0]:
                    heapq.heapreplace(heap, (value, -c))
            floor[rows] = [h[0][0] if len(h) == k else -np.inf for h in heaps[rows]]
    return heaps


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20
) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by ``every`` its k nearest others.

    Nearest is the largest inner product, ties go to the smaller id; fewer than k candidates give fewer rows. Vectors that
    are null, empty or zero, or hold null or non-finite components, and rows without an id take no part. Vectors of different
    lengths are not comparable. Components of any size of doubles are taken as they are: a product may be infinite or zero, and a
    sum that is no number (infinite parts of both signs) counts as minus infinity. Of rows with one id the largest vector counts, as arrays are ordered. Other columns play no
    part; an empty table gives an empty result.
    """
    vector = F.col("vector")
    rows = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        .where(F.col("id").isNotNull() & vector.isNotNull())
        .where(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vector, lambda x: x != 0))
        .groupBy("id")
        .agg(F.max("vector").alias("vector"))
        .withColumn("dimension", F.size("vector"))
    )
    is_query = F.pmod("id", F.lit(every)) == 0
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    stripes, bands = max(1, -(-n // CANDIDATE_STRIPE)), max(1, -(-n_queries // QUERY_STRIPE))
    mine, others = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(bands)), F.pmod(F.xxhash64("id"), F.lit(stripes))
    grid = lambda df, band, stripe: df.select("dimension", band.alias("band"), stripe.alias("stripe"), "id", "vector")
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = grid(rows.where(is_query), mine, numbers(stripes))
    right = grid(rows, numbers(bands), others)

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = lambda t: t["id"].to_numpy()
        matrix = lambda t: t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        out = []
        if queries.num_rows and candidates.num_rows:
            heaps = best_of_stripes(ids(queries), matrix(queries), ids(candidates), matrix(candidates), k)
            out = [(q, -c, s) for q, heap in zip(ids(queries).tolist(), heaps) for s, c in heap]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    key = ["dimension", "band", "stripe"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
