import math
import random

import numpy as np
import pyarrow as pa
import pytest

from compare import connect, difference
from conftest import MEDIUM
from veilframe.llm import near_dedup, queries
from veilframe.llm.common import components, packed

SCHEMA = "doc_id long, text string, kept string, digest int"


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    w = [x for x in lowered.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=85):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    out = []
    for i, (doc_id, *_) in enumerate(rows):
        ids = [r[0] for r, x in zip(rows, label) if x == label[i] and r[0] is not None]
        low = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted((tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).drop("text_hash", "chosen").collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_families_of_near_copies(spark, monkeypatch):
    """Hundreds of variants around a text, from linked to far, over chunks smaller than a bucket."""
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    monkeypatch.setattr(near_dedup, "SLAB", 100)
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = [(1000 - i, edited(rng, base, rng.choice([0, 1, 1, 2, 3, 5, 8])), None, 0) for i in range(260)]
    rows += [(2000 + i, rows[i % 7][1], "copy", 1) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "a", 1), (2, "", None, None), (3, " \t\n", None, None), (None, "a b c", None, None), (4, "A\nb  C", None, 1), (5, "a b c d", None, 1)]
    rows += [(None, "lone text of five words", None, 1), (6, long, None, 1), (6, long, None, 1), (7, long + " more", None, 1), (8, "É b c", "", 1), (9, "é b c", "", 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    con = connect(MEDIUM)
    assert difference(queries.QUERIES[name](spark, MEDIUM), con, queries.ORACLES[name]) is None


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 1 << 63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[400:2400])
    union = np.unique(np.concatenate([a, b]))
    ra, rb, ru = near_dedup.sketches(np.concatenate([a, b, union]), np.array([len(a), len(b), len(union)]))
    assert np.array_equal(np.maximum(ra, rb), ru)
    true = []
    for _ in range(60):
        x = rng.integers(1, 1 << 63, 260).astype(np.uint64)
        pair = near_dedup.sketches(np.concatenate([x[:240], x[20:]]), np.array([240, 240]))
        true.append(near_dedup.estimate(pair[:1], pair[1:], np.array([240.0]), np.array([240.0]))[0])
    j = 220 / 260
    assert abs(np.mean(true) - j) < 0.02 and np.std(true) < 1.6 * math.sqrt(j * (1 - j) / near_dedup.REGISTERS)


def test_sets_do_not_depend_on_the_slice():
    texts = ["a b c d e f", "", None, "x y", "B c D e F g " * 50]
    whole, counts = near_dedup.shingle_sets(*packed(pa.array(texts, pa.string())), 5)
    alone = [near_dedup.shingle_sets(*packed(pa.array([t], pa.string())), 5) for t in texts]
    assert counts.tolist() == [c[0] for _, c in alone] == [len(shingles(t)) for t in texts]
    assert np.array_equal(whole, np.concatenate([k for k, _ in alone]))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(50)] + [(100, 100)]
    rng.shuffle(chain)
    got = dict(map(tuple, components(spark.createDataFrame(chain + star + chain[:5], "a long, b long"), "t").collect()))
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(51)}}
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_bands_suffice_for_the_similarity():
    """The chance to share no band stays below one in a million at any similarity that is not refused."""
    assert near_dedup.banding(85) == (25, 5)
    for percent in range(11, 101):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= near_dedup.REGISTERS and (1 - (percent / 100) ** rows) ** bands <= 1e-6
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(None, percent=10)
