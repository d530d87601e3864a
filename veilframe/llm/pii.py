"""Personal data in whole texts: base patterns, and a character-level bidirectional LSTM with a CRF on top.

The model is trained in numpy, on the driver, from a bounded sample of windows whose labels are the spans that the base
patterns find. A text is covered by overlapping windows; each is decoded by Viterbi, and the spans of all windows of a text
are reconciled together: a span cut by a window's edge is left to the neighbour that sees it whole, and of overlapping spans
the one further from its window's edges stays. What is added has to be evident by itself (`settled`), that is, to hold a digit, an
at sign or the word for one, from ``BEFORE`` code points before its window to ``BEHIND`` behind it. Where there is none of these
nothing can be added whatever the model says, and the window need not be decoded; all others are.

The labelled windows teach what the base patterns know already. So the model also learns from varied copies of them, in which the
same data are written as people write them otherwise: words or brackets for the at sign and dots, spaced or bracketed addresses,
other separators in cards and phone numbers, phones without a plus, two cards in a row. Its spans are added where they touch no
base span, begin and end no inner part of a word or number, and hold what their kind needs once separators are set aside: a whole
address, four parts up to 255, 14 to 19 digits that pass Luhn, 10 to 15 digits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, pick, share, slices
from veilframe.session import materialise

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match cannot start inside a run of digits: the run's start would have matched before, or ended in a match.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def valid(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the e-mail pattern; walking from each at sign keeps long runs of letters linear."""
    end, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < sign and (domain := _DOMAIN.match(text, sign + 1)):
            end = domain.end()
            yield start, end
        sign = text.find("@", max(sign + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; leftmost matches of each kind, failing ones dropped."""
    found = [(s, KINDS.index("email"), e) for s, e in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(m.start(), KINDS.index(kind), m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


CODES, PAD, OTHER = 130, 129, 128
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE = 96, 48
#: How far before and behind what the model has seen a span may begin and end.
BEFORE, BEHIND = 16, 32
HIDDEN = 24
SAMPLE_WINDOWS = 2000
SAMPLE_DOCS = 50_000
#: Each kind of window, with or without a span, has limit // LEAST_SHARE places in the sample.
LEAST_SHARE = 4
EPOCHS, BATCH, STEP, DECAY = 6, 24, 0.02, 0.85
#: Varied copies of each window with a span that the model learns from besides the window itself.
VARIED = 2
#: Ends of the host names that varied copies make up.
ENDINGS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk")
_AT = r"(?:@|\s+@\s*|\s*@\s+|\s+(?:at|AT)\s+|\s*[\[({]\s*(?:at|AT|@)\s*[\])}]\s*)"
_DOT = r"(?:\.|\s+\.\s*|\s*\.\s+|\s+(?:dot|DOT)\s+|\s*[\[({]\s*(?:dot|DOT|\.)\s*[\])}]\s*)"
#: A word for the at sign, where an evident e-mail address may go on around it.
_WORD_SIGN = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?=[\s\[({{])(?={_AT}[A-Za-z0-9-]+{_DOT}[A-Za-z0-9-])")
#: What a span of the model has to look like as a whole; separators are free within bounds.
_EVIDENT = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:[\s\[\](){}.,-]{1,5}[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\s./_-]{0,3}[0-9])+"),
    "phone": re.compile(r"\+?[\s(]*[0-9](?:[\s()./-]{0,3}[0-9])+"),
}


def char_codes(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), OTHER).astype(np.int64)


def _triggers(codes: np.ndarray) -> np.ndarray:
    """Where a text holds what every evident span holds: a digit, an at sign, or a word for one between a name and a host.

    Of other characters only spaces play a part in that, so all of them are taken for spaces.
    """
    found = (codes >= 48) & (codes <= 57) | (codes == 64)
    text = np.where(codes < OTHER, codes, 32).astype(np.uint8).tobytes().decode("ascii")
    found[[m.start() for m in _WORD_SIGN.finditer(text)]] = True
    return found


def windows(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and padded codes of all windows that a span can be added from; overlapping windows cover the whole text."""
    count = max(1, -(-max(len(codes) - WINDOW, 0) // STRIDE) + 1)
    starts = np.arange(count) * STRIDE
    seen = np.concatenate([[0], np.cumsum(_triggers(codes))])
    starts = starts[seen[np.minimum(starts + WINDOW + BEHIND, len(codes))] > seen[np.maximum(starts - BEFORE, 0)]] if len(codes) else starts[:0]
    padded = np.concatenate([codes, np.full(WINDOW, PAD)])
    return starts, padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(spans: list[tuple[int, int, str]], length: int) -> np.ndarray:
    """Tags of a text; where kinds overlap the longer span is written last."""
    tags = np.zeros(length, np.int64)
    for s, e, kind in sorted(spans, key=lambda x: x[1] - x[0]):
        tags[s:e] = 2 * KINDS.index(kind) + 2
        tags[s] = 2 * KINDS.index(kind) + 1
    return tags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Tagger:
    """Weights: for each direction input (CODES, 4H) and recurrent (H, 4H) gates; emissions; CRF start and transitions."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (CODES, 4 * HIDDEN))
            w[f"x{d}"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
            w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w["o"], w["c"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), np.zeros(TAGS)
        w["start"], w["move"] = np.zeros(TAGS), np.zeros((TAGS, TAGS))
        return Tagger({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, codes: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (L, N, H) of one direction, in text order."""
        n, length = codes.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((length, n, HIDDEN), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = self.weights[f"x{d}"][codes[:, t]] + h @ self.weights[f"h{d}"]
            s, g = _sigmoid(a[:, : 3 * HIDDEN]), np.tanh(a[:, 3 * HIDDEN :])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[t] = h
            if keep is not None:
                keep.append((t, before_h, before_c, i, f, o, g, th))
        return out

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(codes, "f"), self._run(codes, "b")], axis=2)
        return both @ self.weights["o"] + self.weights["c"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi tags (N, L)."""
        e = self.emissions(codes)
        length, n, _ = e.shape
        back = np.empty((length, n, TAGS), np.int8)
        best = self.weights["start"] + e[0]
        for t in range(1, length):
            ways = best[:, :, None] + self.weights["move"]
            back[t] = ways.argmax(1)
            best = ways.max(1) + e[t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(n), tags[:, t]]
        return tags

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags, and its gradients."""
        w, (n, length) = self.weights, codes.shape
        keep = {"f": [], "b": []}
        both = np.concatenate([self._run(codes, d, keep[d]) for d in "fb"], axis=2)
        e = both @ w["o"] + w["c"]
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = w["start"] + e[0]
        for t in range(1, length):
            alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + w["move"], 1)
        for t in range(length - 2, -1, -1):
            beta[t] = _log_sum(w["move"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = _log_sum(alpha[-1], 1)
        rows, g = np.arange(n), {k: np.zeros_like(v) for k, v in w.items()}
        de = np.exp(alpha + beta - total[None, :, None])
        score = w["start"][tags[:, 0]] + e[0, rows, tags[:, 0]]
        g["start"] = de[0].sum(0) - np.bincount(tags[:, 0], minlength=TAGS)
        for t in range(1, length):
            pair = np.exp(alpha[t - 1][:, :, None] + w["move"] + (e[t] + beta[t])[:, None, :] - total[:, None, None])
            g["move"] += pair.sum(0)
            np.add.at(g["move"], (tags[:, t - 1], tags[:, t]), -1)
            score = score + w["move"][tags[:, t - 1], tags[:, t]] + e[t, rows, tags[:, t]]
        de[np.arange(length)[:, None], rows[None, :], tags.T] -= 1
        de /= n
        g["start"], g["move"] = g["start"] / n, g["move"] / n
        g["o"], g["c"] = np.einsum("lnh,lnk->hk", both, de), de.sum((0, 1))
        dh_all = de @ w["o"].T
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            for t, h0, c0, i, f, o, gg, th in reversed(keep[d]):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - th * th)
                da = np.concatenate([dc * gg * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                np.add.at(g[f"x{d}"], codes[:, t], da)
                g[f"h{d}"] += h0.T @ da
                dh, dc = da @ w[f"h{d}"].T, dc * f
        return float((total - score).mean()), g


def train(codes: np.ndarray, tags: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Tagger:
    """A tagger by Adam over shuffled batches of windows."""
    model, rng = Tagger.fresh(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    n = 0
    for epoch in range(epochs):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            _, g = model.gradients(codes[order[at : at + BATCH]], tags[order[at : at + BATCH]])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            n += 1
            for k, v in g.items():
                v = v * min(1.0, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                step = STEP * DECAY**epoch * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
                model.weights[k] = (model.weights[k] - step).astype(np.float32)
    return model


def spans_of_tags(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of one row of tags: a begin tag and the inside tags of its kind after it."""
    out, start, kind = [], -1, -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        if kind >= 0 and tag != 2 * kind + 2:
            out.append((start, t, KINDS[kind]))
            kind = -1
        if tag % 2:
            start, kind = t, tag // 2
    return out


def reconciled(text: str, found: list[tuple[int, list[tuple[int, int, str]]]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that the decoded windows (start, spans within) of a text add to its base spans."""
    ranked = set()
    for at, spans in found:
        for s, e, kind in spans:
            cut = s == 0 and at > 0 or e == WINDOW and at + WINDOW < len(text)
            if not cut and e + at <= len(text):
                ranked.add((-min(s, WINDOW - e), s + at, e + at, kind))
    taken, added = list(base), []
    for _, s, e, kind in sorted(ranked):
        if (whole := settled(text, s, e, kind)) and all(whole[1] <= a or whole[0] >= b for a, b, _ in taken):
            taken.append((*whole, kind))
            added.append((*whole, kind))
    return added


def settled(text: str, s: int, e: int, kind: str) -> tuple[int, int] | None:
    """Where the span that the model has seen at s to e really lies: there without what borders it, if that is evident, else where
    its kind's evidence covers most of it; None if nowhere."""
    while s < e and text[e - 1] in " .,;:()-":
        e -= 1
    while s < e and text[s] in " .,;:()-" and not (text[s] == "(" and kind == "phone" and ")" in text[s:e]):
        s += 1

    def apart(a: int, b: int) -> bool:
        return not (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "+") or b < len(text) and text[b].isalnum())

    if s < e and apart(s, e) and evident(kind, text[s:e]):
        return s, e
    near = [m.span() for m in _EVIDENT[kind].finditer(text, max(0, s - BEFORE), e + BEHIND)] if s < e else []
    shared = lambda m: min(e, m[1]) - max(s, m[0])
    best = max(near, key=shared, default=(0, 0))
    return best if 2 * shared(best) >= e - s and apart(*best) and evident(kind, text[best[0] : best[1]]) else None


def evident(kind: str, match: str) -> bool:
    """Whether a text holds by itself what a span of its kind needs."""
    if not _EVIDENT[kind].fullmatch(match):
        return False
    parts = re.findall("[0-9]+", match)
    digits = "".join(parts)
    if kind == "ip":
        return all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def otherwise(kind: str, text: str, rng: np.random.Generator) -> list[tuple[str, str | None]]:
    """A span's text written in another way, or another one of its kind, in pieces (text, kind or None between two spans)."""
    pick_ = lambda *some: some[int(rng.integers(len(some)))]
    if kind == "email":
        name, _, host = text.partition("@")
        letters = lambda n: "".join(chr(97 + int(k)) for k in rng.integers(0, 26, n))
        if rng.random() < 0.6:  # another person at another host
            name = pick_(name, letters(4), letters(3) + "." + letters(5), letters(6) + str(rng.integers(100)))
            host = ".".join([letters(int(rng.integers(3, 9))) for _ in range(int(rng.integers(1, 3)))] + [pick_(*ENDINGS)])
        at, dot = pick_("@", " at ", " [at] ", "(at)", " (at) ", " @ "), pick_(" dot ", "[.]", " . ", " [dot] ", "(dot)", ".")
        return [(name + at + host.replace(".", dot), kind)]
    drawn = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    if kind == "card":
        body = drawn(15)
        other = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if rng.random() < 0.3:
            return [(text, kind), (" ", None), (other, kind)]
        return [(pick_(".", "  ", " - ", "/", "_").join(other[k : k + 4] for k in range(0, 16, 4)), kind)]
    if kind == "ip":
        return [(pick_(" . ", "[.]", "-", " ", ". ", ", ").join(text.split(".")), kind)]
    land, area, rest = str(rng.integers(1, 100)), drawn(3), drawn(7)
    forms = [f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"{area} {rest[:3]} {rest[3:]}"]
    forms += [f"{land} ({area}) {rest[:3]}-{rest[3:]}", f"00{land} {area} {rest}", f"+{land}/{area}/{rest[:3]}/{rest[3:]}"]
    return [(pick_(*forms), kind)]


def varied(codes: np.ndarray, tags: np.ndarray, copies: int = VARIED, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Copies of the windows that hold whole spans, with these spans written otherwise."""
    rng, out = np.random.default_rng(seed), []
    for line, tag in zip(codes.repeat(copies, 0), tags.repeat(copies, 0)):
        spans = [(s, e, kind) for s, e, kind in spans_of_tags(tag) if e < WINDOW]
        if not spans:
            continue
        new_codes, new_tags, at = [], [], 0
        for s, e, kind in spans:
            new_codes += line[at:s].tolist()
            new_tags += tag[at:s].tolist()
            for piece, of in otherwise(kind, "".join(map(chr, line[s:e].tolist())), rng):
                new_codes += char_codes(piece).tolist()
                new_tags += tags_of([(0, len(piece), of)], len(piece)).tolist() if of else [0] * len(piece)
            at = e
        new_codes += [*line[at:].tolist(), *[PAD] * WINDOW]
        new_tags += [*tag[at:].tolist(), *[0] * WINDOW]
        out.append((new_codes[:WINDOW], new_tags[:WINDOW]))
    both = np.array(out, np.int64).reshape(len(out), 2, WINDOW)
    return both[:, 0], both[:, 1]


def labelled_windows(docs: DataFrame, limit: int = SAMPLE_WINDOWS, sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Codes and tags of at most ``limit`` different windows that a span can be added from, from about ``sample_docs`` documents
    chosen by hash.

    Those whose hashes come first, except that windows with a span and windows without one have a quarter of ``limit`` each,
    as far as there are so many. So neither copies of a text nor many windows of one kind fill the sample.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            codes_out, tags_out = [], []
            for text in _texts(rows, data, offsets).values():
                codes = char_codes(text)
                tags = np.concatenate([tags_of(base_spans(text), len(codes)), np.zeros(WINDOW, np.int64)])
                starts, cut = windows(codes)
                codes_out += [c.astype(np.uint8).tobytes() for c in cut]
                tags_out += [tags[s : s + WINDOW].astype(np.uint8).tobytes() for s in starts.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(codes_out, pa.binary()), pa.array(tags_out, pa.binary())], ["codes", "tags"])

    sampled = share(docs, sample_docs, "doc_id", "text").select("text")
    made = arrow_map(sampled, make, "codes binary, tags binary").distinct().withColumn("place", F.xxhash64("codes"))
    made, order = materialise(made, "windows"), ("place", "codes", "tags")
    blank = F.col("tags") == F.lit(bytes(WINDOW))
    tagged, plain = (made.where(kind).orderBy(*order).limit(limit).collect() for kind in (~blank, blank))
    key = lambda r: tuple(r[c] for c in order)
    least = limit // LEAST_SHARE
    take = sum(any(r["tags"]) for r in sorted(tagged + plain, key=key)[:limit])
    take = max(min(len(tagged), max(take, least)), limit - len(plain)) if take < least else min(take, limit - min(len(plain), least))
    chosen = sorted(tagged[:take] + plain[: limit - take], key=key)
    read = lambda c: np.array([np.frombuffer(r[c], np.uint8) for r in chosen], np.int64).reshape(len(chosen), WINDOW)
    return read("codes"), read("tags")


def _texts(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> dict[int, str]:
    """The texts of a slice that are not empty, by row."""
    raw = data.tobytes()
    return {t: raw[offsets[t] : offsets[t + 1]].decode() for t in np.flatnonzero(offsets[1:] > offsets[:-1]).tolist()}


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted((s, KINDS.index(k), e, k) for s, e, k in spans))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_windows: int = SAMPLE_WINDOWS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of ``docs``.

    Counts and checksum are those of the base spans; ``spans`` holds the model's spans as well. A null text is empty and has
    no spans. Null ids and rows that repeat are rows like any other. Other columns
    play no part. An empty table gives an empty result; without labelled windows there is no model and nothing is added.
    """
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    codes, tags = labelled_windows(docs, sample_windows, sample_docs)
    model = train(*(np.concatenate(x) for x in zip((codes, tags), varied(codes, tags)))) if tags.any() else None

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for rows, data, offsets in slices(batches):
            texts = _texts(rows, data, offsets)
            base = {t: base_spans(text) for t, text in texts.items()}
            found: dict[int, list] = {t: [] for t in texts}
            if model and texts:
                cut = {t: windows(char_codes(text)) for t, text in texts.items()}
                owners = np.concatenate([np.full(len(s), t) for t, (s, _) in cut.items()])
                starts = np.concatenate([s for s, _ in cut.values()])
                held = np.concatenate([c for _, c in cut.values()])
                for at in range(0, len(held), 1024):
                    tags = model.decode(held[at : at + 1024])
                    for k in np.flatnonzero(tags.any(1)).tolist():
                        found[int(owners[at + k])].append((int(starts[at + k]), spans_of_tags(tags[k])))
            added = {t: reconciled(texts[t], found[t], base[t]) for t in texts}
            n = rows.num_rows
            count = np.zeros((len(KINDS), n), np.int64)
            for t, spans in base.items():
                for _, _, kind in spans:
                    count[KINDS.index(kind), t] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    *[pa.array(c) for c in count],
                    pa.array([hashlib.sha256(joined(base[t]).encode()).hexdigest() if base.get(t) else nothing for t in range(n)], pa.string()),
                    pa.array([joined(base[t] + added[t]) if t in texts else "" for t in range(n)], pa.string()),
                    pa.array([len(added.get(t, ())) for t in range(n)], pa.int64()),
                ],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    return arrow_map(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
