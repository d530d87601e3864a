import random
import re

import numpy as np

from veilframe.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id long, tokens string"


def split(text):
    return re.findall("(?:[0-9A-Za-z]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_tiles(item, text, least=3):
    """Greedy string tiling as it is stated: compare every position with every other."""
    used, out = (set(), set()), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and item[i + n] and i + n not in used[0] and j + n not in used[1]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= least:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if not used[0] & set(range(i, i + best)) and not used[1] & set(range(j, j + best)):
                used[0].update(range(i, i + best))
                used[1].update(range(j, j + best))
                out.append((i, j, best))
        if not found:
            return out


def test_tiles_agree_with_plain_tiling():
    rng = random.Random(0)
    for _ in range(200):
        item = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 20))], np.uint64)
        text = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 40))], np.uint64)
        assert d.tiles(item, text) == plain_tiles(item.tolist(), text.tolist())


def brute(docs, items, coverage=0.5):
    out = set()
    for doc_id, text, *_ in docs:
        for item_id, passage in items:
            item, words = split(passage), split(text)
            matched = sum(n for *_, n in plain_tiles(item, words)) if len(item) >= 3 else 0
            if item and matched >= coverage * len(item) and matched:
                out.add((doc_id, item_id, len(item), matched))
    return sorted(out, key=repr)


def test_planted_passages(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "THE", "the"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.randint(8, 20))) for i in range(12)] + [(50, "one two"), (51, None), (52, ""), (None, line(9))]
    docs = [(i, line(40), None, "x") for i in range(25)]
    for i in range(12):
        w = items[i][1].split()
        cut = len(w) // 2
        docs.append((100 + i, f"{line(10)} {' '.join(w).upper().replace(' ', ', ')}! {line(5)}", 1, "x"))
        docs.append((200 + i, f"{' '.join(w[cut:])}.\n{line(15)} {' '.join(w[:cut])}", 1, "x"))
        docs.append((300 + i, f"{line(4)} {' '.join(w[: len(w) // 2])} {line(4)}", 1, "x"))
    docs += [docs[-1], docs[30], (400, None, 1, "x"), (401, "", 1, "x"), (None, items[2][1], 1, None), (402, line(6000) + " " + items[3][1], 1, "x")]
    table = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(*x, 1, "y") for x in items + items[:1]], "item_id long, text string, doc_id long, seeds string")
    rows = d.contaminated(table, bench).collect()
    got = sorted(((r["doc_id"], r["item_id"], r["item_tokens"], r["matched_tokens"]) for r in rows), key=repr)
    want = brute([x for x in docs if x[0] != 402], items)
    assert [g for g in got if g[0] != 402] == want and {(402, 3)} <= {g[:2] for g in got}
    assert {100 + i for i in range(12)} | {200 + i for i in range(12)} <= {g[0] for g in got}
    assert any(r["reordered"] for r in rows if (r["doc_id"] or 0) // 100 == 2)
    assert d.contaminated(table.where("false"), bench).collect() == [] and d.contaminated(table, bench.where("false")).collect() == []
