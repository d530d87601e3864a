import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import packing
from veilframe.llm.common import packed
from veilframe.llm.tokens import Encoder, default_vocabulary

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length int, piece string"


def plain(text):
    from tokenizers import Tokenizer

    plain.made = getattr(plain, "made", None) or Tokenizer.from_file(default_vocabulary())
    return plain.made.encode(text or "", add_special_tokens=False).ids


def encoded(texts):
    import pyarrow as pa

    ids, counts = Encoder.of(default_vocabulary()).encode(*packed(pa.array(texts, pa.string())))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab' \n\t\r  　\u0085  éß中🙂1!<|>.’dst\x1c"), max_size=40), min_size=1, max_size=5))
def test_units_give_the_ids_of_the_whole_text(texts):
    assert encoded(texts) == [plain(t) for t in texts]


def test_special_strings_and_long_runs():
    texts = ["a <|endoftext|> b", "  <|endoftext|>", "x" * 5000, " " * 3000, "", None, "I've  don't\n\n we'll"]
    assert encoded(texts) == [plain(t) for t in texts]


LONG_RUNS = [c * 3_000_000 for c in " \n\t"] + ["\u3000" * 1_000_000, "word" + " \t" * 700_000 + "end", "a\u3000" + "\u3000" * 400_000 + "b  c", "x" * 150_000 + " y"]


@pytest.mark.parametrize("text", LONG_RUNS, ids=range(len(LONG_RUNS)))
def test_very_long_white_space(text):
    assert encoded(["before", text, "after  it"]) == [plain("before"), plain(text), plain("after  it")]


def test_very_long_white_space_in_tables(spark):
    rows = [(k, t) for k, t in enumerate([" " * 1_000_000, "a" + "\n" * 1_200_000 + "b", None, "", "a a", "a a"])]
    docs = spark.createDataFrame([(i, t, "x", "y", 1, 7, "z") for i, t in rows], SCHEMA)
    got = packing.pack(docs).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected_pieces(rows))
    check_layout(got)
    lengths = [len(plain(t)) for _, t in rows]
    assert {tuple(r) for r in packing.length_histogram(docs).collect()} == {(n, lengths.count(n)) for n in lengths}


def expected_pieces(rows, capacity=1024):
    for doc_id, text in rows:
        ids = [*plain(text), 2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield doc_id, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_layout(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs).collect()
    want = sorted(expected_pieces([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = check_layout(rows)
    assert sequences <= 1.02 * -(-sum(r["length"] for r in rows) // 1024) + 1


def test_pack_odd_rows(spark):
    rows = [(1, None, None, None, None, 1, "x"), (None, "", "en", "s", 0, 2, "y"), (2, "word " * 9000, None, "s", 1, 3, "z"), (2, "word " * 9000, None, "s", 1, 3, "z"), (3, "  \n", None, None, None, None, None)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out))) == sorted(map(repr, expected_pieces([(r[0], r[1]) for r in rows])))
    check_layout(out)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_plan_places_every_piece_once(capacity):
    rng = random.Random(capacity)
    for _ in range(30):
        lengths = {n: rng.randint(1, 50) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        rows, seen = [], {}
        for length, low, high, first, offset in packing.plan(lengths, capacity):
            for k in range(high - low):
                assert (length, low + k) not in seen
                seen[length, low + k] = True
                rows.append({"sequence_id": first + k, "offset": offset, "length": length})
        assert len(seen) == sum(lengths.values()) and all((n, k) in seen for n, c in lengths.items() for k in range(c))
        used = check_layout(rows, capacity)
        assert used >= max(-(-sum(n * c for n, c in lengths.items()) // capacity), sum(c for n, c in lengths.items() if 2 * n > capacity))


def test_plan_pairs_two_large_at_most():
    placed = packing.plan({400: 3, 350: 3, 600: 2, 342: 1}, 1024)
    by = {}
    for length, low, high, first, _ in placed:
        for k in range(high - low):
            by.setdefault(first + k, []).append(length)
    assert max(len(v) for v in by.values()) == 2 and len(by) == 5


def test_context_totals_answer_every_limit(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    lengths = [len(plain(r["text"])) for r in docs.select("text").collect()]
    rows = sorted(packing.context_totals(packing.length_histogram(docs)).collect(), key=lambda r: r["length"])
    assert [r["length"] for r in rows] == sorted(set(lengths))
    for r in rows:
        limit = r["length"]
        assert r["n_docs"] == lengths.count(limit) and r["docs_longer"] == sum(n > limit for n in lengths)
        assert r["tokens_longer"] == sum(n for n in lengths if n > limit)
        assert r["kept_tokens"] == sum(min(n, limit) for n in lengths) and r["kept_tokens"] + r["lost_tokens"] == sum(lengths)
        assert r["docs_at_most"] == sum(n <= limit for n in lengths)
        assert r["rank_high"] == r["docs_at_most"] / len(lengths)
    assert packing.context_totals(packing.length_histogram(docs.where("false"))).collect() == []
    odd = packing.length_histogram(spark.createDataFrame([(None,), ("",), ("a a",)], "text string"))
    assert sorted(map(tuple, odd.collect())) == [(0, 2), (2, 1)]
