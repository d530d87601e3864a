import math
import random

from veilframe.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string"


def brute(rows, every=20, k=20):
    best = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = max(best.get(i, v), v)
    out = []
    for q in best:
        if q % every == 0:
            scored = []
            for c in best:
                if c != q and len(best[c]) == len(best[q]):
                    total = 0.0
                    for x, y in zip(best[q], best[c]):
                        total += x * y
                    scored.append((-total, c))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, **kw):
    return sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, SCHEMA), **kw).collect())


def test_ties_nulls_and_odd_vectors(spark, monkeypatch):
    rng = random.Random(1)
    whole = lambda n: [float(rng.randint(-3, 3)) for _ in range(n)]  # noqa: E731  many ties
    rows = [(i, whole(8), 0, "a", None) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, -1.0], 0, "b", "c") for i in range(10)]
    rows += [(300, None, 0, None, None), (320, [0.0] * 8, 0, None, None), (340, [1.0, None] + [0.0] * 6, 0, None, None)]
    rows += [(360, [math.nan] * 8, 0, None, None), (380, [math.inf] * 8, 0, None, None), (400, [], 0, None, None), (None, whole(8), 0, None, None)]
    rows += [rows[0], rows[0], (20, [3.0] * 8, 1, None, None)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=3, every=7) == brute(rows, 7, 3)
    assert found(spark, []) == []


def test_stripes_and_tiles_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_STRIPE", 16)
    monkeypatch.setattr(ann, "CANDIDATE_STRIPE", 90)
    rng = random.Random(2)
    import struct

    near = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    rows = [(i, [near(rng.gauss(0, 1)) for _ in range(16)], 0, None, None) for i in range(600)]
    assert found(spark, rows, every=10, k=5) == brute(rows, 10, 5)


def test_tiles_keep_the_heap_over_many_tiles(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ann, "TILE", 7)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 5))
    ids = np.arange(150)
    heaps = ann.best_of_stripes(ids[:20], x[:20], ids, x, 4)
    rows = [(i, v) for i, v in zip(ids.tolist(), x.tolist())]
    want = brute([r for r in rows], 1, 4)
    got = sorted((q, r + 1, -c, s) for q, h in enumerate(heaps) for r, (s, c) in enumerate(sorted(h, reverse=True)))
    assert got == [w for w in want if w[0] < 20]


def test_any_size_of_doubles(spark):
    """Squares and products that leave the range of doubles lose no neighbour."""
    schema = "vec_id long, embedding array<double>"
    rng = random.Random(4)
    for size in (1e-170, 1e-160, 1e150, 1e200, None):
        scale = lambda: size or 10.0 ** rng.randint(-300, 150)
        rows = [(i, [rng.gauss(0, 1) * s for _ in range(6)]) for i in range(300) for s in (scale(),)]
        rows += [(1000, [1e-200, 0.0] + [0.0] * 4), (1001, [1e200, 0.0] + [0.0] * 4), (1020, [5e-324] * 6), (1040, [1e308] * 6), (1041, [1e308, -1e308] * 3)]
        got = sorted(map(tuple, ann.nearest(spark.createDataFrame(rows, schema), every=10, k=5).collect()))
        want = []
        for q, left in rows:
            if q % 10 == 0:
                scored = []
                for c, right in rows:
                    if c != q:
                        total = 0.0
                        for x, y in zip(left, right):
                            total += x * y
                        scored.append((math.inf if math.isnan(total) else -total, c))
                want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scored)[:5])]
        assert got == sorted(want)
