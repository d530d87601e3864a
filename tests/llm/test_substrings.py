import random

import numpy as np

from veilframe.llm import substrings as sub

SCHEMA = "doc_id long, text string, span_start int, number string"


def plain_chunks(raw):
    """Chunks by a loop over the bytes with the hash rolled from the text's start."""
    out, at, h = [], 0, 0
    for i, b in enumerate(raw):
        h = ((h << 2) + int(sub._GEAR[b])) % 2**32
        n = i + 1 - at
        if n >= sub.SHORTEST and h >> (32 - sub.ZERO_BITS) == 0 or n == sub.LONGEST or i + 1 == len(raw):
            out.append(raw[at : i + 1])
            at = i + 1
    return out


def text_of(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(words))


def test_chunks_agree_with_rolling():
    rng = random.Random(0)
    raws = [text_of(rng, rng.randint(0, 300)).encode() for _ in range(40)] + [b"", b"x", b"ab" * 3000, "é中".encode() * 200]
    data, offsets = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    ends, counts = sub.chunk_ends(data, offsets)
    at = 0
    for raw, base, n in zip(raws, offsets.tolist(), counts.tolist()):
        cuts = [0, *(ends[at : at + n] - base).tolist()]
        assert [raw[a:b] for a, b in zip(cuts, cuts[1:])] == plain_chunks(raw)
        at += n


def brute(rows, least=sub.LEAST_WORDS):
    import re
    from collections import Counter

    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1]})
    raws = [text.encode() for _, _, text in order]
    first = {}
    for n, raw in enumerate(raws):
        at = 0
        for c in plain_chunks(raw):
            first.setdefault(c, (n, at))
            at += len(c)
    out = []
    for n, (null, doc_id, _) in enumerate(order):
        raw, at, run = raws[n], 0, []
        begins = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        for c in [*plain_chunks(raw), None]:
            if c is not None and first[c][0] < n:
                run.append((at, at + len(c), first[c][0], first[c][1] - at))
            elif run:
                lo, hi = run[0][0], run[-1][1]
                if sum(lo <= b < hi for b in begins) * sub.SEED_PART >= least:
                    votes = Counter(r[2:] for r in run)
                    source, shift = min(votes, key=lambda v: (-votes[v], v))
                    mine = [r for r in run if r[2:] == (source, shift)]
                    other, left, right = raws[source], mine[0][0], mine[-1][1]
                    most = (max(0, left - sub.BEFORE + 1), min(len(raw), right + sub.AFTER - 1))
                    while left > most[0] and left + shift > 0 and raw[left - 1] == other[left + shift - 1]:
                        left -= 1
                    while right < most[1] and right + shift < len(other) and raw[right] == other[right + shift]:
                        right += 1
                    lo, hi = min(lo, left), max(hi, right)
                    words = sum(lo <= b < hi for b in begins)
                    if words >= least:
                        null2, id2, _ = order[source]
                        out.append((None if null else doc_id, lo, hi, len(run), words, None if null2 else id2))
                run = []
            at += len(c or b"")
    return sorted(out, key=repr)


def found(spark, rows):
    return sorted(map(tuple, sub.repeated_spans(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


def test_planted_passages(spark):
    rng = random.Random(1)
    passages = [text_of(rng, 51) for _ in range(6)]
    rows = [(i, text_of(rng, 200), 1, "x") for i in range(30)]
    for i in range(60):
        rows.append((100 + i, f"{text_of(rng, rng.randint(0, 80))} {passages[i % 6]} {text_of(rng, rng.randint(0, 80))}", 1, "x"))
    rows += [(200, "same same " * 400, 1, None), (201, rows[3][1], None, None), (None, passages[0], 1, "y")]
    got = found(spark, rows)
    assert got == brute(rows)
    caught = {g[0] for g in got}
    assert {106 + i for i in range(54)} | {201, None} <= caught and not caught & {*range(30), 200}


def test_passages_of_51_words_are_found_whole(spark):
    """A thousand pairs that share 51 words, and as many that share 45: all of the first with every word, none of the others."""
    rng, rows, planted = random.Random(7), [], {}
    for i in range(2000):
        size = 51 if i < 1000 else 45
        passage = text_of(rng, size)
        for k in (0, 1):
            before = text_of(rng, rng.randint(1, 60))
            rows.append((10 * i + k, f"{before} {passage} {text_of(rng, rng.randint(1, 60))}", 1, "x"))
        planted[10 * i + 1] = (len(before) + 1, len(before) + 1 + len(passage), size)
    got = {g[0]: g for g in found(spark, rows)}
    assert set(got) == {d for d, (_, _, size) in planted.items() if size == 51}
    for d, g in got.items():
        assert g[1] <= planted[d][0] and planted[d][1] <= g[2] and g[5] == d - 1


def test_growth_agrees_with_loops():
    rng = random.Random(3)
    for side, width in enumerate((sub.BEFORE, sub.AFTER)):
        pairs = []
        for _ in range(300):
            same = bytes(rng.choices(b"ab \n", k=rng.randint(0, width)))
            pairs.append(tuple((same + bytes(rng.choices(b"ab ", k=rng.randint(0, 9))))[:width] for _ in (0, 1)))
        pairs += [(None, b"ab"), (b"ab", None), (None, None), (b"", b"")]
        within = np.array([rng.choice([0, 0, 5, 400]) for _ in pairs])
        lengths, words = sub.growth([p[0] for p in pairs], [p[1] for p in pairs], within, side)
        for (a, b), skip, length, begun in zip(pairs, within.tolist(), lengths.tolist(), words.tolist()):
            a, b, n = a or b"", b or b"", 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            blank = lambda i: i >= len(a) or a[i] in b" \n"  # noqa: B023, E731
            if side:
                assert (length, begun) == (max(n - 1 - skip, 0), sum(not blank(i) and blank(i - 1) for i in range(1 + skip, n)))
            else:
                n = min(n, width - 1)
                assert (length, begun) == (max(n - skip, 0), sum(not blank(i) and blank(i + 1) for i in range(skip, n)))


def test_odd_rows(spark):
    long = text_of(random.Random(2), 30_000)
    rows = [(1, None, None, None), (2, "", 1, "x"), (3, "short", 1, "x"), (3, "short", 1, "x"), (4, long, 1, "x"), (5, "new " + long, 1, "x"), (5, "new " + long, 1, "x")]
    got = found(spark, rows)
    assert got == brute(rows) and {g[0] for g in got} == {5}
    assert found(spark, []) == []
