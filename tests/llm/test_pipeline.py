import corpus_pipeline as cp
from test_decontaminate import split
from test_near_dedup import brute as near_brute
from test_packing import check_layout, expected_pieces

from veilframe.llm import decontaminate, lines, quality
from veilframe.llm.common import packed

MEDIUM = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark, monkeypatch, tmp_path):
    """Each stage on what its predecessor kept."""
    import numpy as np
    import pyarrow as pa

    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in cp.STAGES:
        seen.append((docs, sorted(map(tuple, docs.collect()))))
        docs = cp.materialise(stage(spark, docs, MEDIUM), name)
        assert name == "packing" or docs.columns == columns
    (_, raw), (good_df, good), (lined_df, lined), (near_df, near), (clean_df, clean) = seen

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    model = quality.fit(seen[0][0].select("doc_id", "text"), spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    scores = model.scores(quality.statistics(*packed(pa.array([r[1] for r in raw]))))
    assert good == [r for r, s in zip(raw, scores) if s >= 0.3]
    kept = {r[0] for r in good}
    assert np.mean([i in kept for i, q in labels.items() if q]) > 0.98 and np.mean([i in kept for i, q in labels.items() if not q]) < 0.15

    gone = {}
    for r in lines.similar_lines(good_df).where("removed").collect():
        gone.setdefault(r["doc_id"], set()).add(r["line_no"])
    want = []
    for r in good:
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone.get(r[0], ()))
        want.append((r[0], text, *r[2:4], len(text)))
    assert lined == want and any(gone.values())

    ids = {r[0] for r in near_brute([(r[0], r[1]) for r in lined]) if r[3]}
    assert near == [r for r in lined if r[0] in ids]

    items = [np.array([hash(t) % 2**62 + 1 for t in split(r["text"])], np.uint64) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    left = []
    for r in near:
        text = np.array([hash(t) % 2**62 + 1 for t in split(r[1])], np.uint64)
        if not any(sum(n for *_, n in decontaminate.tiles(i, text)) >= decontaminate.COVERAGE * len(i) for i in items):
            left.append(r)
    assert clean == left and len(clean) < len(near)

    pieces = docs.collect()
    assert sorted((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == sorted(expected_pieces([r[:2] for r in clean]))
    check_layout(pieces)


def test_odd_rows_go_through(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "some words of a text " * 3000, "en", None, 1), (2, "some words of a text " * 3000, "en", None, 1), (None, "one line\none line", "en", "s", 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        count = docs.count()
        for name, stage in cp.STAGES:
            docs = cp.materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert (docs.count() > 0) == (count > 0)


def test_near_duplicates_from_four_fifths(spark):
    """Pairs between 0.80 and 0.85 go as well, those just below 0.80 stay."""
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    rows = []
    for k in range(40):  # n words in front of an own ending: Jaccard (n - 4) / (n + 16)
        n = (80, 84, 100, 110)[k % 4]
        rows += [(100 * k + e, " ".join(words(k, n) + [f"end{k}y{e}z{i}" for i in range(10)]), "en", "s", 0) for e in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted(r[0] for r in near_brute([r[:2] for r in rows], 80) if r[3])
    assert sorted(r["doc_id"] for r in cp.drop_near_duplicates(spark, docs, MEDIUM).collect()) == want
    assert 40 < len(want) < sum(r[3] for r in near_brute([r[:2] for r in rows]))


def test_near_duplicates_without_ids(spark):
    """One of three near copies without an id stays, and every row without words."""
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:-1] + [f"end{k}"]) for k in range(3)]
    rows = [(None, t, "en", "s", 0) for t in near] + [(None, t, lang, source, 0) for t, lang, source in ((None, "en", "s"), (None, "en", "t"), ("", "de", "s"), ("", "de", "s"))]
    rows += [(7, " ".join(words), "fr", "u", 0), (7, " ".join(words[:-1] + ["other"]), "fr", "u", 0), (9, "alone here", "fr", "u", 0), (9, "alone here", "de", "u", 0)]
    for part, groups in ((rows[:7], 1), (rows[:9], 1), (rows, 2)):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long")
        kept = cp.drop_near_duplicates(spark, docs, MEDIUM).collect()
        assert sum(not (r["text"] or "").strip() for r in kept) == 4
        with_words = [r for r in kept if (r["text"] or "").strip()]
        assert len(with_words) == groups and (len(part) == 7 or {r["doc_id"] for r in with_words} <= {7, 9})
