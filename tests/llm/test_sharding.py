import math
import zlib
from collections import Counter

import numpy as np

from veilframe.llm import sharding

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, shard string, slot long"


def check(rows, texts, shards=24):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts
    )
    by = Counter(r["shard"] for r in rows)
    counts = [by[j] for j in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(texts)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(j, s) for j in range(shards) for s in range(counts[j])]
    assert {r["law"] for r in rows} <= {"rows"} and {r["grown_shard"] for r in rows} <= {None}


def test_whole_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(sharding.shard(docs).collect(), texts)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)  # many blocks for a partition
    first = sharding.shard(docs.repartition(3, "doc_id")).collect()
    check(first, texts)
    assert sorted(map(tuple, first), key=repr) == sorted(map(tuple, sharding.shard(docs.repartition(3, "doc_id")).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "", None, None), (2, "é" * 50_000, "y", 3)]
    check(sharding.shard(spark.createDataFrame(rows, SCHEMA)).collect(), [r[:2] for r in rows])
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).collect() == []


def test_matrix_is_exact_and_hypergeometric():
    blocks, shards = [1000, 1, 0, 37, 5000], [1510, 1510, 1509, 1509]
    total = np.zeros((5, 4))
    for seed in range(400):
        m = sharding.communication_matrix(blocks, shards, seed)
        assert m.sum(1).tolist() == blocks and m.sum(0).tolist() == shards and m.min() >= 0
        total += m
    assert np.allclose(total / 400, np.outer(blocks, shards) / 6038, rtol=0.2, atol=1)
    u = np.random.default_rng(0).random(20_000)
    ours = [sharding.hypergeometric(30, 70, 20, x) for x in u]
    theirs = np.random.default_rng(1).hypergeometric(30, 70, 20, 20_000)
    assert abs(np.mean(ours) - 6) < 0.05 and abs(np.std(ours) - np.std(theirs)) < 0.05
    big = [sharding.hypergeometric(10**12, 23 * 10**12, 1 << 20, x) for x in u[:200]]
    assert abs(np.mean(big) - (1 << 20) / 24) < 60


def test_every_deal_is_equally_likely(spark, monkeypatch):
    """Which rows share a shard, drawn by groups of blocks, against the 20 ways to put six rows in two shards of three."""
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 2)
    monkeypatch.setattr(sharding, "GROUP_PARTITIONS", 1)
    docs = spark.createDataFrame([(i, "x", None, None) for i in range(6)], SCHEMA).repartitionByRange(2, "doc_id")
    ways = Counter()
    for blocks in ([2, 1], [1, 2]):
        for seed in range(3000):
            top = sharding.communication_matrix([3, 3], [3, 3], seed)
            low = [sharding.group_matrix(blocks, row.tolist(), seed, k) for k, row in enumerate(top)]
            ways[(tuple(blocks), *(int(m[0, 0]) for m in low), int(top[0, 0]))] += 1
    for (blocks, a, b, k), n in ways.items():
        one = lambda x, k: math.comb(blocks[0], x) * math.comb(blocks[1], k - x)
        chance = one(a, k) * one(b, 3 - k) / math.comb(6, 3)
        assert abs(n - 3000 * chance) < 5 * math.sqrt(3000 * chance) + 1
    check(sharding.shard(docs, shards=2).collect(), [(i, "x") for i in range(6)], 2)
