import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import queries, runs
from veilframe.llm.common import GOLDEN, U64, mixed

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, runs string, n_words long, collapsed int, start int, period string"


def brute(words, least=4, least_length=6):
    out, n = [], len(words)
    for q in range(1, n // least + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least_length, least * q):
                part = words[i : i + length]
                if not any(part[p:] == part[: length - p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def hashes(words):
    return mixed(np.array([w + 1 for w in words], U64) * U64(GOLDEN))


def found(texts, least=4, least_length=6):
    counts = np.array([len(t) for t in texts])
    return list(zip(*(x.tolist() for x in runs.runs_of(hashes([w for t in texts for w in t]), counts, least, least_length))))


few = st.lists(st.integers(0, 2), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(few, st.tuples(few, few, st.integers(2, 9)).map(lambda x: x[0] + x[1][:9] * x[2])), min_size=1, max_size=4), st.sampled_from([2, 3, 4]))
def test_runs_of_several_texts(texts, least):
    assert found(texts, least, 2) == [(t, *r) for t, words in enumerate(texts) for r in brute(words, least, 2)]


def test_words_arrive_one_by_one_or_in_any_steps():
    rng = random.Random(3)
    for trial in range(25):
        words = [rng.randrange(1 + trial % 3) for _ in range(40)]
        catcher, at = runs.SquareCatcher(hashes(words), np.array([0, len(words)])), 0
        while at < len(words):
            step = rng.choice([1, 1, 1, 7])
            catcher.take(step)
            at = min(at + step, len(words))
            assert list(zip(*(x.tolist() for x in catcher.runs()[1:]))) == brute(words[:at], 2, 2)


def test_hard_texts():
    thue = [bin(i).count("1") & 1 for i in range(1 << 13)]  # overlap-free: squares only, and none of exponent above 2
    assert found([thue], 3, 2) == []
    assert found([[0] * 200_000]) == [(0, 0, 200_000, 1)]
    period = list(range(3_333))
    assert found([period * 5, period * 3, period[:50] * 4]) == [(0, 0, 5 * 3_333, 3_333), (2, 0, 200, 50)]
    with pytest.raises(ValueError):
        runs.SquareCatcher(hashes([1]), np.array([0, 1]), 1)


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if doc_id is not None and n:
            h = zlib.crc32(str(doc_id).encode())
            g = h // 10
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        got = brute(words)
        drop = {i for s, length, q in got for i in range(s + q, s + length)}
        best = min(got, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(got), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in got)), digest(" ".join(w for i, w in enumerate(words) if i not in drop))))
    return sorted(out, key=repr)


def test_query_on_the_whole_table(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_square_catcher(spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = expected([tuple(r) for r in rows])
    assert sum(r[1] > 0 for r in want) > 5
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "a", "a " * 6, "a b " * 8 + "a", "x y z " * 4 + "Y Z", "é é " * 9, "w " * 30_000, "q\x0br " * 5000]
    texts += ["one  two\nthree four " * 5 + "a a a a a a", "long " + "ab" * 50_000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a " * 7), (5, texts[5]), (5, texts[5])]
    rows += [(i, "u v w x y z " * 7) for i in range(100, 160)]  # some of them repeat their tails
    table = spark.createDataFrame([(i, t, "en", "r", 1, 2, 3, "p") for i, t in rows], SCHEMA)
    got = queries.run_digests(runs.periodic_runs(queries.repeat_tails(table)))
    assert sorted(map(tuple, got.collect()), key=repr) == expected([(i, t if t is None else t) for i, t in rows])
    plain = {r["doc_id"]: r for r in runs.periodic_runs(table).collect() if r["doc_id"] is not None}
    assert plain[6]["collapsed"] == "x y z Y Z" and plain[6]["n_words"] == 14
    assert runs.periodic_runs(table.where("false")).collect() == []
