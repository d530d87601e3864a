import zlib

import numpy as np

from veilframe.llm import quality
from veilframe.llm.common import packed

SCHEMA = "doc_id long, text string, label int, held_out string"
LABELS = "doc_id long, quality int, toxic int, text string"


def table(texts):
    import pyarrow as pa

    return quality.statistics(*packed(pa.array(texts, pa.string())))


def test_statistics_of_known_texts():
    x = dict(zip(quality.FEATURES, table(["Aa bb, Aa\nBB!! 12|\nBB!! 12|", "other"])[0]))
    assert x["log_words"] == np.log1p(7) and x["distinct_words"] == 4 / 7 and x["top_word"] == 2 / 7
    assert x["distinct_lines"] == 2 / 3 and x["lines_per_word"] == 2 / 7 and x["bar"] == 2 / 7 and x["exclamation"] == 4 / 7
    assert x["digit"] == 4 / 27 and x["capital_words"] == 4 / 7 and x["words_with_symbol_end"] == 4 / 7
    texts = ["Aa bb, Aa\nBB", "", None, "   \n ", "x " * 30_000, "é"]
    alone = np.vstack([table([t]) for t in texts])
    assert np.array_equal(table(texts), alone) and np.isfinite(alone).all()


def test_flat_trees_agree_with_walking_them():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0) | (x[:, 7] > 1.5)).astype(float)
    model = quality.train(x[:2000], y[:2000])

    def walk(row):
        total = model.prior
        for feature, threshold, value in zip(model.feature, model.threshold, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    got = model.scores(x[2000:])
    assert np.allclose(got, [walk(r) for r in x[2000:]])
    assert ((got > 0.5) == (y[2000:] > 0.5)).mean() > 0.95


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
    tested = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p for t, p in tested if t == 1]) > 0.97 and np.mean([1 - p for t, p in tested if t == 0]) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, 5, "x"), (None, "", None, None), (2, "word " * 20_000, 1, None), (2, "word " * 20_000, 1, None), (3, "a", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([(1, None, 0, "t"), (2, 1, 0, None), (2, 0, 0, None), (None, 1, 0, None)], LABELS)
    out = quality.score_quality(docs, known).collect()
    assert len(out) == 5 and len({r["score"] for r in out if r["doc_id"] == 2}) == 1
    assert [r["held_out"] for r in out if r["doc_id"] is None] == [False]
    assert {r["score"] for r in quality.score_quality(docs, known.where("false")).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), known).collect() == []


def test_an_id_that_repeats_is_one_training_row(spark):
    """A hot id brings one row, whichever order its rows come in; the model is that of the table without repeats."""
    rows = [(i, ("good words here. " if i % 2 else "BAD!! || 123 <> ") * (1 + i % 9)) for i in range(200)]
    hot = [(1, f"variant {k} of a hot text") for k in range(300)] + [(2, rows[2][1])] * 300
    docs = spark.createDataFrame(rows + hot, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0, None) for i in range(200)], LABELS)
    known = labels.selectExpr("doc_id", "quality AS label")
    first = quality.labelled_rows(docs, known).collect()
    assert len(first) == 200 and {r["doc_id"] for r in first} == set(range(200))
    assert sorted(first) == sorted(quality.labelled_rows(docs.orderBy("text").repartition(3), known).collect())
    one = docs.selectExpr("*", "xxhash64(text) AS h").groupBy("doc_id").agg({"h": "min"}).toDF("doc_id", "h")
    alone = docs.selectExpr("*", "xxhash64(text) AS h").join(one, ["doc_id", "h"]).select("doc_id", "text").distinct()
    a, b = quality.fit(docs, labels), quality.fit(alone, labels)
    assert len(a.feature) and a.prior == b.prior and np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)
