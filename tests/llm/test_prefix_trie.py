import hashlib
import random
import zlib

import numpy as np
import pytest

from veilframe.llm import prefix_trie, queries
from veilframe.llm.common import U64

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, hi string, turns int, depth int, nodes string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in by.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def expected(paths):
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    below = {n: [0, 0, 0] for n in nodes}  # children, leaves, saved
    for n in sorted(nodes, key=len, reverse=True):
        b = below[n]
        b[1] += b[0] == 0
        b[2] += (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        if n:
            up = below[n[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + b[1], up[2] + b[2]
    ends = {}
    for c in sorted(paths):
        ends.setdefault(tuple(paths[c]), []).append(str(c))
    return sorted(
        (
            (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), *below[n], hashlib.sha256(",".join(ends.get(n, [])).encode()).hexdigest())
            for n, m in nodes.items()
        ),
        key=repr,
    )


def trie(spark, rows):
    sequences = prefix_trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))
    got = queries.trie_digests(prefix_trie.prefix_paths(queries.borrowed_starts(sequences)))
    assert sorted(got.columns) == sorted(COLUMNS)
    return sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr)


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = queries.op13_hash_trie(spark, SMALL).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rebuilt(map(tuple, rows)))


def conversations(rng, n):
    rows = []
    for c in range(n):
        common = rng.random()
        for t in range(rng.randint(1, 10)):
            text = "same" if common < 0.4 else rng.choice(["a", "b", "é ü", "", None])
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["user", None]) if common > 0.9 else "user", text, "x", 1, 2, "y"))
    return rows


@pytest.mark.parametrize("heavy", [1, 5, 10_000])
def test_spine_and_shards(spark, monkeypatch, heavy):
    """From all nodes in the spine to none of them, with ranges and pieces of ends cut short."""
    monkeypatch.setattr(prefix_trie, "HEAVY", heavy)
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 9)
    rows = conversations(random.Random(heavy), 300)
    assert trie(spark, rows) == expected(rebuilt(rows))


def test_odd_rows(spark):
    odd = lambda *r: (*r, None, None, 0, None)
    assert trie(spark, []) == []
    assert trie(spark, [odd(None, 1, "user", "lost")]) == []
    # Conversation 3 borrows from an absent one, and 7 takes more turns than it has itself from none.
    rows = [odd(c, t, None, None) for c in (3, 7, 8, 9) for t in (None, 0)]
    assert trie(spark, rows) == expected(rebuilt(rows))
    rows = [odd(5, t, "user", "long " * 20_000) for t in range(4)] + [odd(c, t, "user", f"t{t}") for c in (10, 11, 12) for t in range(3_000)]
    rows += [odd(5, 2, "user", "long " * 20_000)] * 2
    assert trie(spark, rows) == expected(rebuilt(rows))


def test_turns_named_alike(spark):
    """Role and text do not run into one another, and no text is like an empty one but null."""
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "", "abc"), (4, 0, None, "abc"), (6, 0, "abc", None), (7, 0, "abc", "")]
    found = prefix_trie.prefix_paths(prefix_trie.turn_sequences(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).collect()
    ends = {r["conv_id"]: (r["end_hi"], r["end_lo"]) for r in found}
    assert len(set(ends.values())) == 4 and ends[3] == ends[4] and ends[6] == ends[7]


def test_slots_are_minimal_and_checked():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 50_000):
        hi, lo = (rng.integers(0, 1 << 63, n).astype(U64) for _ in range(2))
        hi[: n // 2] = 7  # digests that agree in half of their bits
        table = prefix_trie.SlotTable(hi, lo)
        assert sorted(table.slots(hi, lo).tolist()) == list(range(n))
        assert (table.slots(hi, lo + U64(1)) == -1).all()
    with pytest.raises(ValueError):
        prefix_trie.SlotTable(np.array([1, 1], U64), np.array([2, 2], U64))
