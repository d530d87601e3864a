import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veilframe.llm import class_lm, queries
from veilframe.llm.common import packed, word_hashes, words

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, score double, w long, n int, rare string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]  # None is the end


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def units(text, named):
    data, offsets = packed(pa.array([text or ""]))
    starts, ends, _ = words(data, offsets)
    return class_lm.units_of(data, starts, ends, word_hashes(data, starts, ends), named).tolist()


def expected(rows, model):
    """Scores by plain counting, given the model's classes alone."""
    train = [r for r in rows if not is_held(r[0])]
    counts = Counter(t for r in train for t in tokens(r[1]))
    n, v, last = sum(counts.values()), len(counts), class_lm.CLASSES - 1
    line_of = lambda text: [int(model.classes[u]) for u in units(text, model.named)] + [last]
    tri, bi, uni, of_class, rare = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, text in train:
        line = [last, last, *line_of(text)]
        for a, b, c in zip(line, line[1:], line[2:]):
            tri[a, b, c] += 1
            bi[b, c] += 1
            uni[c] += 1
            of_class[c] += 1
        for u in units(text, model.named):
            rare[int(model.classes[u])] += u >= class_lm.NAMED
    types2, types1, total2, total1 = Counter(), Counter(), Counter(), Counter()
    for (a, b, _), k in tri.items():
        types2[a, b] += 1
        total2[a, b] += k
    for (b, _), k in bi.items():
        types1[b] += 1
        total1[b] += k

    def transition(a, b, c):
        p = (uni[c] + 1) / (sum(uni.values()) + class_lm.CLASSES)
        if total1[b]:
            p = (bi[b, c] + types1[b] * p) / (total1[b] + types1[b])
        if total2[a, b]:
            p = (tri[a, b, c] + types2[a, b] * p) / (total2[a, b] + types2[a, b])
        return p

    unseen = sum(k == 1 and t is not None for t, k in counts.items()) / (sum(rare.values()) + 1)
    out = []
    for doc_id, text in rows:
        base = score = 0.0
        line = [last, last, *line_of(text)]
        for word, unit, a, b, c in zip(tokens(text), [*units(text, model.named), None], line, line[1:], line[2:]):
            base += math.log10((counts[word] + 0.5) / (n + 0.5 * (v + 1)))
            p = transition(a, b, c)
            if word is not None:
                if not counts[word]:
                    p *= (unseen * rare[c] + 1) / (of_class[c] + 1)
                else:
                    p *= (1 if unit < class_lm.NAMED else 1 - unseen) * counts[word] / (of_class[c] + 1)
            score += math.log10(p)
        out.append((doc_id, is_held(doc_id), len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), n, base, score))
    return out


def run(spark, rows, monkeypatch):
    models, fit = [], class_lm.fit
    monkeypatch.setattr(class_lm, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    monkeypatch.setattr(queries, "_read", lambda *_: rows)
    got = queries.op12_brown_classes(spark, SMALL)
    return [tuple(r) for r in got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()], models[-1]


def close(got, want):
    order = lambda r: (repr(r[:5]), round(r[5], 6), round(r[6], 6))
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("counted", [1 << 20, 40])
def test_scores_of_the_whole_table(spark, monkeypatch, counted):
    """Also where nearly all words are counted by the join."""
    monkeypatch.setattr(class_lm, "COUNTED", counted)
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got, model = run(spark, table, monkeypatch)
    assert len(model.counted) <= counted
    close(got, expected([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], model))
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert model.rounds[1] > model.rounds[0]


def test_odd_rows(spark, monkeypatch):
    texts = [None, "", " \n", "one", "One one ONE two", "é ü " * 50, "a b " * 20_000, "new words only here", "x" * 100_000]
    rows = [(k, t) for k, t in enumerate(texts * 4)] + [(None, "one two"), (3, "two"), (3, "two")]
    table = spark.createDataFrame([(i, t, "x", 0.5, 1, 2, "r") for i, t in rows], SCHEMA)
    got, model = run(spark, table, monkeypatch)
    close(got, expected(rows, model))
    assert run(spark, table.where("false"), monkeypatch)[0] == []
    only = [i for i in range(100) if is_held(i)][:3]
    rows = [(i, "never seen") for i in only]  # nothing to learn from
    got, model = run(spark, spark.createDataFrame([(i, t, "x", 0.5, 1, 2, "r") for i, t in rows], SCHEMA), monkeypatch)
    assert [r[3:6] for r in got] == [(0, 0, 0.0)] * 3 and all(math.isfinite(r[6]) for r in got)


def test_probabilities_sum_to_one(spark):
    model = class_lm.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert np.allclose((10**model.transitions).reshape(-1, class_lm.CLASSES).sum(1), 1)
    data, offsets = packed(pa.array([r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]))
    starts, ends, _ = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    _, first, n = np.unique(hashes, return_index=True, return_counts=True)
    unit = class_lm.units_of(data, starts[first], ends[first], hashes[first], model.named)
    of = model.classes[unit]
    p = 10 ** (np.where(unit < class_lm.NAMED, model.of_named[of], model.of_rare[of]) + np.log10(n))
    total = np.bincount(of, p, class_lm.CLASSES) + 10**model.of_unseen
    assert np.allclose(total[np.unique(of)], 1)


def test_exchange_moves_up_the_likelihood():
    """Every move of a round is the best of all by brute force, and the copy of the matrix stays true."""
    rng = random.Random(4)
    n = 12
    counts = np.array([[rng.choice([0, 0, 1, 2, 9]) for _ in range(n)] for _ in range(n)], float)
    classes = np.array([rng.randrange(4) for _ in range(n)], np.int16)

    def matrix_of(classes):
        m = np.zeros((class_lm.CLASSES,) * 2)
        for a in range(n):
            for b in range(n):
                m[classes[a], classes[b]] += counts[a, b]
        return m

    def side(counts):
        out = np.zeros((n, class_lm.CLASSES))
        for a in range(n):
            for b in range(n):
                out[a, classes[b]] += counts[a, b]
        return out

    for k in range(n):  # one unit at a time, as a part of its own
        alone = np.array([k])
        moved = class_lm.exchange(alone, side(counts)[alone], side(counts.T)[alone], counts[alone, alone], classes, matrix_of(classes))
        best = -math.inf
        for c in range(class_lm.CLASSES - 1):
            trial = classes.copy()
            trial[k] = c
            best = max(best, class_lm.likelihood(matrix_of(trial)))
        classes[k] = moved[0]
        assert class_lm.likelihood(matrix_of(classes)) == pytest.approx(best)
