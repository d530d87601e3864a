import hashlib
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_ip int"
#: The base patterns as they are stated.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card":
                twice = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab.@-+%_ 0123456789()é\n"), max_size=60))
def test_base_spans_are_those_of_the_stated_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_base_spans_known():
    text = "é mail a.b@c-d.org., ip 10.0.0.255 or 10.0.0.256, card 4111 1111 1111 1111, call +1 (555) 010-9999."
    assert [(text[s:e], k) for s, e, k in pii.base_spans(text)] == [
        ("a.b@c-d.org", "email"), ("10.0.0.255", "ip"), ("4111 1111 1111 1111", "card"), ("+1 (555) 010-9999", "phone")
    ]
    assert pii.base_spans("a" * 100_000 + "1" * 100_000) == []  # linear


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    model = pii.Tagger.fresh(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    codes, tags = rng.integers(40, 60, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, g = model.gradients(codes, tags)
    for name, at in (("xf", (50, 3)), ("xb", (50, 40)), ("hf", (2, 30)), ("hb", (5, 80)), ("o", (4, 2)), ("c", (1,)), ("start", (2,)), ("move", (1, 2))):
        keep, losses = model.weights[name][at], []
        for step in (1e-2, -1e-2):
            model.weights[name][at] = keep + step
            losses.append(model.gradients(codes, tags)[0])
        model.weights[name][at] = keep
        assert abs((losses[0] - losses[1]) / 2e-2 - g[name][at]) < 2e-3


def test_windows_cover_and_reconcile():
    text = "word " * 30 + "x@y.zz " + "word " * 30
    starts, cut = pii.windows(pii.char_codes(text))
    assert len(starts) and cut.shape[1] == pii.WINDOW
    at = text.index("x@")
    exact = [(int(s), [(at - int(s), at + 6 - int(s), "email")]) for s in starts if s <= at and at + 6 <= s + pii.WINDOW]
    assert pii.reconciled(text, exact, []) == [(at, at + 6, "email")]
    assert pii.reconciled(text, exact, [(at - 1, at + 2, "ip")]) == []
    assert pii.reconciled(text, [(48, [(0, 9, "email")])], []) == []  # cut by the edge


def test_model_learns_held_out_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    codes, tags = pii.labelled_windows(docs, 1500)
    model = pii.train(codes[:1200], tags[:1200])
    got = model.decode(codes[1200:])
    spans = lambda rows: Counter((n, s) for n, r in enumerate(rows) for s in pii.spans_of_tags(r))
    ours, truth = spans(got), spans(tags[1200:])
    both = sum((ours & truth).values())
    assert both > 0.9 * sum(truth.values()) and both > 0.85 * sum(ours.values())


def test_queries_columns_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    rows = pii.personal_data(docs, sample_windows=300).collect()
    assert len(rows) == sum(texts.values())
    by = {i: t for i, t in texts}
    for r in rows:
        want = plain(by[r["doc_id"]])
        text = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]
        assert set(text.split(",") if text else []) <= set(r["spans"].split(",")) and len(r["spans"].split(",")) >= len(want)
    odd = spark.createDataFrame([(1, None, "a", 1), (None, "", None, None), (2, "x@y.zz " * 20_000, None, 2), (2, "x@y.zz " * 20_000, None, 2)], SCHEMA)
    out = pii.personal_data(odd, sample_windows=50).collect()
    assert sorted(r["n_email"] for r in out) == [0, 0, 20_000, 20_000] and len(out) == 4
    assert pii.personal_data(odd.where("false")).collect() == []


def test_copies_of_a_window_do_not_fill_the_sample(spark):
    """Windows are distinct, and those with a span keep their place beside many without one and beside copies."""
    rows = [(k, f"hot text number {k % 3} without a span") for k in range(3000)]
    rows += [(10_000 + k, f"plain text {k} of its own kind") for k in range(300)]
    rows += [(20_000 + k, f"write to person{k}@example{k}.org today") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    codes, tags = pii.labelled_windows(docs, 100)
    both = np.concatenate([codes, tags], axis=1)
    assert len(both) == 100 == len(np.unique(both, axis=0))
    assert tags.any(1).sum() >= 25
    codes, tags = pii.labelled_windows(docs, 300)
    assert len(codes) == 300 and tags.any(1).sum() == 60
    codes, tags = pii.labelled_windows(docs.where("doc_id < 10000 or doc_id >= 20000"), 1000)
    assert len(codes) == 63 and tags.any(1).sum() == 60
    assert pii.labelled_windows(docs, 0)[0].shape[0] == 0


def test_best_tags_against_all_sequences():
    rng = np.random.default_rng(5)
    model = pii.Tagger.fresh(2)
    model.weights = {k: rng.normal(0, 1, v.shape) for k, v in model.weights.items()}
    codes = rng.integers(40, 60, (2, 3))
    for row in codes:
        every = np.array(np.meshgrid(*[range(pii.TAGS)] * 3)).reshape(3, -1).T
        loss = [model.gradients(row[None], tags[None])[0] for tags in every]
        assert model.decode(row[None])[0].tolist() == every[int(np.argmin(loss))].tolist()


def test_evidence():
    good = {
        "email": ["a.b@c.org", "a.b at c dot org", "a [at] c[.]d-e (dot) fr", "a @ c . io"],
        "ip": ["1.2.3.4", "10 . 0 . 0 . 255", "10[.]0[.]0[.]1", "1-2-3-4"],
        "card": ["4111111111111111", "4111.1111.1111.1111", "4111  1111  1111  1111"],
        "phone": ["(974) 555-3436", "0048 974 5553436", "+48/974/555/3436"],
    }
    bad = {
        "email": ["a.b", "what c", "a at b", "a@b."],
        "ip": ["1.2.3", "1.2.3.256", "1.2.3.4.5", "1x2x3x4"],
        "card": ["4111111111111112", "411111111111", "4111111111111111 4111111111111111"],
        "phone": ["555-3436", "1234567890123456", "12-34-56-78-9a"],
    }
    for kind in pii.KINDS:
        assert all(pii.evident(kind, t) for t in good[kind]) and not any(pii.evident(kind, t) for t in bad[kind])
    at = "see x4111111111111111 or 4111111111111111"
    assert pii.settled(at, 5, 21, "card") is None and pii.settled(at, 25, 41, "card") == (25, 41)
    mail = "write to tom12 [at] abc[.]net now"
    assert pii.settled(mail, 9, 25, "email") == (9, 29)  # the model stopped short
    assert pii.settled("12 34", 0, 5, "phone") is None


def planted(texts, seed):
    """Each text with a span of a kind, written in a way that the base patterns do not know, and where it lies."""
    rng = np.random.default_rng(seed)
    whole = {"email": "lee@post.example.org", "ip": "", "card": "", "phone": "+1 (555) 010-9999"}
    for k, text in enumerate(texts):
        kind = pii.KINDS[k % 4]
        whole["ip"] = ".".join(map(str, rng.integers(1, 256, 4)))
        body = "".join(map(str, rng.integers(0, 10, 15)))
        whole["card"] = next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))
        at, out, want = text.index(" ", len(text) // 2) + 1, "", []
        for piece, of in pii.otherwise(kind, whole[kind], rng):
            want += [(at + len(out), at + len(out) + len(piece), of)] if of else []
            out += piece
        text = text[:at] + out + text[at - 1 :]
        base = pii.base_spans(text)
        yield text, base, [w for w in want if all(w[1] <= a or w[0] >= b for a, b, _ in base)]


def test_model_adds_spans_that_the_base_patterns_miss(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    codes, tags = pii.labelled_windows(docs, 1200)
    more = pii.varied(codes, tags)
    assert more[0].shape == more[1].shape and len(more[0]) == pii.VARIED * sum(any(e < pii.WINDOW for _, e, _ in pii.spans_of_tags(t)) for t in tags)
    model = pii.train(np.concatenate([codes, more[0]]), np.concatenate([tags, more[1]]))

    def added(text, base):
        starts, cut = pii.windows(pii.char_codes(text))
        found = [(int(s), pii.spans_of_tags(t)) for s, t in zip(starts, model.decode(cut))] if len(cut) else []
        return pii.reconciled(text, found, base)

    plain_texts = [r["text"] for r in docs.where("doc_id < 3000 AND length(text) BETWEEN 200 AND 3000").collect()]
    clean = [t for t in plain_texts if not any(c.isdigit() or c == "@" for c in t)][:240]
    hits = wanted = got = 0
    for text, base, want in planted(clean, 99):
        spans = added(text, base)
        hits, wanted, got = hits + len(set(spans) & set(want)), wanted + len(want), got + len(spans)
    assert hits >= 0.7 * wanted and hits >= 0.95 * got  # recall and precision of what is added
    numbers = ["version 3.2.1 of 2024-01-05", "token = '04dbebab91ab85687d33eeaaf9ac699e1188f962'", "9807915762804490 items", "call 555 now", "at 12:30 or 13:45:10.250"]
    assert [added(f"{clean[k]} {t} {clean[k]}", []) for k, t in enumerate(numbers)] == [[]] * len(numbers)


def test_no_window_is_left_out_from_which_a_span_could_be_added():
    """Whatever the model says in a window that is not decoded, nothing is evident there; words for signs count too."""
    rng = np.random.default_rng(8)
    signs = [" at ", " AT ", "[at]", " (at) ", "{AT}", "\u00a0at\u00a0", " @ ", "@"]
    dots = [".", " dot ", "[.]", " . ", "\u2003dot ", "(DOT)"]
    added = 0
    for k in range(60):
        fill = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 9))) for _ in range(60))
        at = int(rng.integers(0, len(fill)))
        mail = "tom" + "x" * int(rng.integers(0, 30)) + signs[k % len(signs)] + "host" + dots[k % len(dots)] + "org"
        text = f"{fill[:at]} {mail} {fill[at:]}"
        decoded = set(pii.windows(pii.char_codes(text))[0].tolist())
        for start in range(0, max(len(text) - pii.WINDOW, 0) + pii.STRIDE, pii.STRIDE):
            said = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, pii.WINDOW - 12, 40), rng.integers(2, 80, 40)) if s + n <= pii.WINDOW]
            evident = [pii.settled(text, start + s, min(start + e, len(text)), kind) for s, e in said for kind in pii.KINDS if start + s < len(text)]
            assert start in decoded or not any(evident)
            added += any(evident)
        assert decoded
    assert added > 60
    for plain_text in ("we met at the end. Then we left", "look at that", "", "\u00e9\u00e9"):
        assert not len(pii.windows(pii.char_codes(plain_text))[0])


def test_texts_without_digits_and_at_signs_are_shown_to_the_model(spark, monkeypatch):
    """A model that knows one address written in words finds it wherever it lies."""
    said = "anna at garden dot org"

    class Knows:
        def decode(self, codes):
            tags = np.zeros(codes.shape, np.int64)
            for k, row in enumerate(codes):
                at = "".join(map(chr, row)).find(said)
                if at >= 0:
                    tags[k, at : at + len(said)] = 2
                    tags[k, at] = 1
            return tags

    monkeypatch.setattr(pii, "train", lambda codes, tags: Knows())
    texts = ["write to a.b@c.org", said, f"please ask {said} about it", "word " * 100 + said + " word" * 100, "anna at home. Then", None, ""]
    out = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = {k: f"email:{t.index(said)}:{t.index(said) + len(said)}" for k, t in enumerate(texts) if t and said in t}
    assert {r["doc_id"]: r["spans"] for r in out if r["n_added"]} == want and all(r["n_email"] == (r["doc_id"] == 0) for r in out)
