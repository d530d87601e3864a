import random

import numpy as np

from veilframe.llm import lines

SCHEMA = "doc_id long, text string, line_no string, removed int"


def word_set(line):
    for c in "\t\v\f\r":
        line = line.replace(c, " ")
    return frozenset("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in line.split(" ") if w)


def brute(spark, rows):
    """(doc_id, line_no, n_links, removed) of lines with words, by comparing all lines."""
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    every = []
    for r in table:
        for n, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            if s := word_set(line):
                every.append(((r["doc_id"] is None, r["doc_id"] or 0, r["h"], n), s, r["doc_id"]))
    sets = {s for _, s, _ in every}
    near = {s: [t for t in sets if t != s and 5 * len(s & t) >= 4 * len(s | t)] for s in sets}
    first = {}
    for at, s, _ in every:
        first[s] = min(first.get(s, at), at)
    out = []
    for at, s, doc_id in every:
        early = min([first[s], *(first[t] for t in near[s])])
        name = f"{'null' if first[s][0] else first[s][1]}:{first[s][3]}"
        out.append((doc_id, at[3], name, len(near[s]), early < at))
    return sorted(out, key=repr)


def found(spark, rows):
    out = lines.similar_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(((r["doc_id"], r["line_no"], r["class_id"], r["n_links"], r["removed"]) for r in out), key=repr)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(400)}"
    return " ".join(words)


def make_rows(rng, docs):
    bases = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 4, 5, 9, 12, 30, 54, 57]))] for _ in range(14)]
    rows = []
    for i in range(docs):
        text = "\n".join(edited(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2, 4])) for _ in range(rng.randint(1, 4)))
        rows.append((i * 7 % docs, text, "x", 1))
    return rows


def test_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    rows = make_rows(rng, 90)
    assert found(spark, rows) == brute(spark, rows)


def test_crowds_in_small_chunks(spark, monkeypatch):
    for name, value in (("CROWD", 3), ("CHUNK", 8), ("SLAB", 16)):
        monkeypatch.setattr(lines, name, value)
    rows = make_rows(random.Random(2), 70)
    assert found(spark, rows) == brute(spark, rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, None, 1), (2, "", "x", None), (3, "\n \n\t\n", None, None), (None, "a b c d e\nA B c d e", None, 1), (4, "a b c d e\n", None, 1)]
    rows += [(5, long + "\n" + long + " z", None, 1), (6, "same row here now\nx", None, 1), (6, "same row here now\nx", None, 1), (7, "e d c b a a", None, 1)]
    assert found(spark, rows) == brute(spark, rows)
    assert found(spark, []) == []


def test_removed_lines_go(spark):
    rows = [(1, "a b c d e\n\nsecond line of it", "x", 1), (2, "own words stay\na b c d e\n", None, 2), (3, None, None, 3), (None, "A B C D E", None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted(map(tuple, lines.without_lines(docs, lines.similar_lines(docs)).collect()), key=repr)
    assert out == sorted([rows[0], (2, "own words stay\n", None, 2), rows[2], (None, "", None, 4)], key=repr)


def test_ordered_sets_do_not_depend_on_the_slice():
    rare = np.random.default_rng(0).integers(0, 5, lines.COUNTERS).astype(np.uint8)
    data = np.frombuffer(b"b a A c\nx\n\nlast b", np.uint8)
    starts, text, number = lines.split_lines(data, np.array([0, 8, 8, 17]))
    assert number.tolist() == [0, 1, 0, 0, 1, 2] and text.tolist() == [0, 0, 1, 2, 2, 2]
    keys, sizes = lines.ordered_sets(data, starts, rare)
    assert sizes.tolist() == [3, 0, 0, 1, 0, 2] and len(keys) == 6


def test_near_pairs_and_what_connects_them():
    rng = np.random.default_rng(5)
    n = 400
    size = rng.integers(4, 70, n)
    key = np.sort(rng.integers(-3, 3, n) << 32 | size)
    size, at = key & 0xFFFFFFFF, rng.integers(0, 3, n)
    d1 = rng.integers(0, 300, n)
    one, two = (rng.integers(0, 4, n).astype(np.uint64) for _ in "ab")
    two[size <= lines.WIDE] = 0
    a, b = lines.near_pairs(key, d1, one, two, at)
    want = set()
    for i in range(n):
        for j in range(i + 1, n):
            x, y = int(one[i] ^ one[j]), int(two[i] ^ two[j])
            apart = x.bit_count() + y.bit_count() if (size[i] > lines.WIDE) == (size[j] > lines.WIDE) else (x ^ y).bit_count()
            if key[i] >> 32 == key[j] >> 32 and d1[i] != d1[j] and 5 * size[i] >= 4 * size[j] and 9 * min(size[i] - at[i], size[j] - at[j]) >= 4 * (size[i] + size[j]):
                if 9 * apart <= size[i] + size[j]:
                    want.add((i, j))
    assert set(zip(a.tolist(), b.tolist())) == want and want

    def parts(edges):
        root = {}
        for x, y in edges:
            rx, ry = root.setdefault(x, x), root.setdefault(y, y)
            root = {k: min(rx, ry) if v in (rx, ry) else v for k, v in root.items()}
        return root

    few = list(zip(a.tolist(), b.tolist()))[::40]
    x, y = lines.connected(np.array([e[0] for e in few]), np.array([e[1] for e in few]))
    assert parts(zip(x.tolist(), y.tolist())) == parts(few) and len(x) <= len(few)


def test_common_words_ship_no_sets(spark, monkeypatch):
    """Lines that share their rarest word with many others, and are similar to one of them at most."""
    for name, value in (("CROWD", 8), ("CHUNK", 16)):
        monkeypatch.setattr(lines, name, value)
    stored = {}
    plain = lines.materialise

    def watched(df, label, *more, **named):
        stored[label] = plain(df, label, *more, **named)
        return stored[label]

    monkeypatch.setattr(lines, "materialise", watched)
    rng = random.Random(4)
    rows = []
    for i in range(300):
        line = f"rare{i % 5} " + " ".join(f"often{w}" for w in rng.sample(range(60), 14))
        rows.append((i, line + (f"\n{line} often60" if i % 50 == 0 else ""), "x", 1))
    assert found(spark, rows) == brute(spark, rows)
    assert 12 <= stored["cells"].count() < 40 and stored["classes"].count() == 306


def test_near_edges_connect_what_first_words_pair(monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", 20)
    rng = np.random.default_rng(6)
    n = 500
    size = rng.integers(4, 70, n)
    key = np.sort(rng.integers(0, 3, n) << 32 | size)
    size, at = key & 0xFFFFFFFF, rng.integers(0, 5, n)
    d1 = rng.integers(0, 400, n)
    one, two = (rng.integers(0, 16, n).astype(np.uint64) for _ in "ab")
    two[size <= lines.WIDE] = 0
    x, y = lines.near_pairs(key, d1, one, two, at)
    first = 9 * (at[x] + at[y]) <= size[x] + size[y]
    a, b = lines.near_edges(key, d1, one, two, at)
    want = lines.connected(d1[x[first]], d1[y[first]])
    assert len(a) and (a.tolist(), b.tolist()) == (want[0].tolist(), want[1].tolist())


def test_packed_rows_come_back():
    rng = np.random.default_rng(7)
    for n in (0, 1, 1000):
        token, cell, size, at = (rng.integers(0, 1 << bits, n) for bits in (32, 32, 7, 4))
        d1, parity, more = (rng.integers(-(1 << 63), 1 << 63, n) for _ in range(3))
        more[size <= lines.WIDE] = 0
        columns = [token, cell, size, at, d1, parity.view(np.uint64), more.view(np.uint64)]
        back = lines.unpack_rows(lines.pack_rows(*columns))
        assert all((x == y).all() and len(x) == n for x, y in zip(columns, back))


def test_shuffle_files_go_with_what_is_stored(spark):
    import time

    from veilframe.session import materialise

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shuffles = lambda: {b for b in env.blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(name)
    stored = materialise(spark.range(1000).repartition(3, "id"), "tidy", tidy=True)
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name) == was and stored.count() == 1000


def test_texts_are_shuffled_after_the_lines(spark):
    rows = [(1, "a b c d e\nown words", "x", 1), (2, "e d c b a\nother words stay", None, 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = lines.without_lines(docs, lines.similar_lines(docs))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "class_id" not in plan and out.count() == 2
