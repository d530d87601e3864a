"""Line dedup by an exact set-similarity join.

A line is the set of its words. Sets are ordered by rarity, so that two sets of Jaccard similarity 0.8 share a word in their
prefixes: they are dealt by prefix words and meet in the order of size, under filters by size, by position of the shared word,
and by a parity signature (the bits in which two signatures differ are words that one set alone has). What is left is verified
on full sets.

Equal sets are one class from the start, and a class sends one prefix. Prefix words are counted before they are dealt: those of
one class stay where they are. A class is dealt as signatures of some 25 bytes, packed by bucket of words, however many classes
share the word; those of a word that very many share are dealt to each two chunks of them. What meets are candidates, of which a
task gives no more than what connects them; their components are compared inside tasks, a set shipped once, so that a family of
near copies costs its members and not its pairs. Only counts leave a task. Full sets are shipped for candidates alone, whatever
words they share, so that disk grows with the input although common words are shared by ever more classes.

Rarity is a logarithm of how often words of a hashed counter occur in all texts; any fixed order gives the same links, so
colliding counters cost time only. A counter of one tells that a word cannot be shared, and it is left out of the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GOLDEN, U64, arrow_map, components, may_hold, membership, mixed, pick, ragged, slices, word_hashes, words
from veilframe.operators.lookup import HEAVY_LIMIT, spread_join
from veilframe.session import materialise, tidy_shuffles

COUNTERS = 1 << 24
BLOCK = 1 << 12
#: Classes that meet at one word in one place; those of a word with more are dealt in chunks of half as many, each two of which meet.
CROWD = 1 << 14
#: Dealt rows of a bucket, about, and rows that a task deals at a time.
BUCKET = 1 << 17
DEALT = 1 << 19
#: Candidate pairs that are held before they are reduced to what connects them.
PAIRS = 1 << 20
CHUNK = 2048
SLAB = 4096
#: Jaccard of 4/5: overlap * 9 >= 4 * (sum of sizes). Sets of three words or fewer match only themselves.
LEAST_SIZE = 4
#: Words above which a set spreads its parity over 128 bits instead of 64. A set at most a quarter larger has its own, so
#: sets on both sides of the border are compared in what they have in common: both halves folded into one.
WIDE = 50


def split_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lines start (and the end of all), their texts and their numbers in them; every text has a line."""
    breaks = np.flatnonzero(data == 10)
    text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, text))
    text, starts = text[order], starts[order]
    number = np.arange(len(text)) - np.searchsorted(text, text, "left")
    return np.append(starts, len(data)), text, number


def rarity(counts: np.ndarray) -> np.ndarray:
    """One byte for a count: 0 for none, 1 for one, four steps for each doubling."""
    return np.where(counts > 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


def ordered_sets(data: np.ndarray, starts: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each line, rarest first, end to end, and how many each line has."""
    begin, end, line = words(data, starts)
    hashes = word_hashes(data, begin, end)
    lines = len(starts) - 1
    step = rare[hashes & U64(COUNTERS - 1)].astype(U64)
    if lines < 1 << 24:
        order = np.argsort(line.astype(U64) << U64(40) | step << U64(32) | hashes >> U64(32), kind="stable")
    else:
        order = np.lexsort((hashes >> U64(32), step, line))
    # Ties in all of these are two words whose hashes share 32 bits: put them in order as well.
    hashes, line, step = hashes[order], line[order], step[order]
    same = (line[1:] == line[:-1]) & (step[1:] == step[:-1]) & (hashes[1:] >> U64(32) == hashes[:-1] >> U64(32))
    if (same & (hashes[1:] != hashes[:-1])).any():
        order = np.lexsort((hashes, step, line))
        hashes, line = hashes[order], line[order]
        same = line[1:] == line[:-1]
    new = np.ones(len(hashes), bool)
    new[1:] = ~(same & (hashes[1:] == hashes[:-1]))
    return hashes[new], np.bincount(line[new], minlength=lines)


def slot_bytes(df: DataFrame, spots: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``step`` of how often each of ``COUNTERS`` spots occurs in all that ``spots`` gives for the batches of ``df``.

    Tasks count in arrays and send what is not zero in blocks, which other tasks add up; a byte for each spot (16 MB at any
    input) reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int32)  # of one task
        for found in spots(batches):
            spot, often = np.unique(found, return_counts=True)
            counts[spot.astype(np.int64)] += often.astype(np.int32)
        spot = np.flatnonzero(counts)
        ends = np.searchsorted(spot, np.arange(0, COUNTERS + BLOCK, BLOCK))
        some = np.flatnonzero(np.diff(ends))
        blocks = [spot[ends[k] : ends[k + 1]] for k in some.tolist()]
        columns = [some, [(x % BLOCK).astype(np.uint16).tobytes() for x in blocks], [counts[x].tobytes() for x in blocks]]
        for at in range(0, len(some), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 256], t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["block", "spots", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}  # no more than COUNTERS numbers
        for batch in batches:
            for block, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(block, np.zeros(BLOCK, np.int64))
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int32)
        columns = [pa.array(list(totals), pa.int64()), pa.array([step(t).tobytes() for t in totals.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["block", "bytes"])

    counted = arrow_map(df, count, "block long, spots binary, counts binary").repartition("block")
    with tidy_shuffles(df.sparkSession):
        got = arrow_map(counted, add, "block long, bytes binary").toArrow()
    out = np.zeros((COUNTERS // BLOCK, BLOCK), np.uint8)
    for block, values in zip(got["block"].to_pylist(), got["bytes"].to_pylist()):
        out[block] = np.frombuffer(values, np.uint8)
    return out.reshape(-1)


def word_counters(docs: DataFrame):
    """A broadcast byte of rarity for each of ``COUNTERS`` hashed words, from all texts (16 MB at any input)."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offsets in slices(batches):
            begin, end, _ = words(data, offsets)
            yield word_hashes(data, begin, end) & U64(COUNTERS - 1)

    return docs.sparkSession.sparkContext.broadcast(slot_bytes(docs.select("text"), spots, rarity))


def _sums(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two order-free 64-bit digests of each set, and its parity signature; the second half only of sets above ``WIDE``."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    total = lambda x: np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x)])[at])
    spot = mixed(keys + U64(3 * GOLDEN % (1 << 64)))
    bit = U64(1) << (spot & U64(63))
    half = (spot >> U64(63)).astype(bool) & (np.repeat(sizes, sizes) > WIDE)
    parities = []
    for own in (np.where(half, U64(0), bit), np.where(half, bit, U64(0))):
        run = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(own)])[at]
        parities.append(run[1:] ^ run[:-1])
    return total(mixed(keys + U64(GOLDEN))), total(mixed(keys ^ U64(GOLDEN))), *parities


def line_table(docs: DataFrame, rare) -> DataFrame:
    """A row for each line with words: doc_id, text_hash, line_no, d1, d2 (digest), size, parity, more, skip, prefix.

    The prefix holds the upper halves of hashes: two words that share one meet in the join for nothing, and are told apart after
    it. It is null where it cannot match another set and where the task has given it before; so are the signatures.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for rows, data, offsets in slices(batches):
            starts, text, number = split_lines(data, offsets)
            keys, sizes = ordered_sets(data, starts, rare.value)
            d1, d2, parity, more = _sums(keys, sizes)
            at = np.concatenate([[0], np.cumsum(sizes)])
            single = np.concatenate([[0], np.cumsum(rare.value[keys & U64(COUNTERS - 1)] == 1)])
            skip = single[at[1:]] - single[at[:-1]]  # words without partners are the rarest, so they come first
            length = sizes - (4 * sizes + 4) // 5 + 1
            kept = np.flatnonzero(sizes > 0)
            fresh = []
            for d, n in zip(d1[kept].tolist(), sizes[kept].tolist()):
                fresh.append(n >= LEAST_SIZE and d not in given)
                given.add(d)
            take = np.zeros(len(sizes), bool)
            take[kept] = fresh
            own = np.where(take, np.maximum(length - skip, 0), 0)
            first = at[:-1] + skip
            spots = np.repeat(first[kept] - (np.cumsum(own[kept]) - own[kept]), own[kept]) + np.arange(own[kept].sum())
            ends = np.concatenate([[0], np.cumsum(own[kept])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(
                pa.array(ends[:-1].tolist() + [int(ends[-1])], mask=np.append(~take[kept], False), type=pa.int32()), pa.array((keys[spots] >> U64(32)).astype(np.uint32).view(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(text[kept])),
                    rows.column(1).take(pa.array(text[kept])),
                    pa.array(number[kept]),
                    pa.array(d1[kept].view(np.int64)),
                    pa.array(d2[kept].view(np.int64)),
                    pa.array(sizes[kept]),
                    pa.array(parity[kept].view(np.int64), mask=~take[kept]),
                    pa.array(more[kept].view(np.int64), mask=~take[kept]),
                    pa.array(skip[kept]),
                    prefix,
                ],
                ["doc_id", "text_hash", "line_no", "d1", "d2", "size", "parity", "more", "skip", "prefix"],
            )

    schema = "doc_id long, text_hash long, line_no long, d1 long, d2 long, size long, parity long, more long, skip long, prefix array<int>"
    return arrow_map(docs, make, schema)


def set_table(docs: DataFrame, wanted: DataFrame, rare) -> DataFrame:
    """d1, d2, keys: full sets; at least those of the lines that ``wanted`` names by place, each once for a task that has it.

    Only lines that a bit set of these places may hold are taken apart again.
    """
    spot = F.col("place.text_hash").bitwiseXOR(F.col("place.line_no"))
    held = membership(wanted.select(spot.alias("spot")), "spot")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[tuple[int, int]] = set()
        for rows, data, offsets in slices(batches):
            starts, text, number = split_lines(data, offsets)
            of = rows.column(0).to_numpy(zero_copy_only=False)[text] ^ number
            some = np.flatnonzero(may_hold(held.value, of.view(U64))).tolist()
            if not some:
                continue
            data = np.concatenate([data[starts[k] : starts[k + 1]] for k in some])
            keys, sizes = ordered_sets(data, np.concatenate([[0], np.cumsum([starts[k + 1] - starts[k] for k in some])]), rare.value)
            d1, d2, *_ = _sums(keys, sizes)
            take = []
            for line in np.flatnonzero(sizes >= LEAST_SIZE).tolist():
                if (name := (int(d1[line]), int(d2[line]))) not in given:
                    given.add(name)
                    take.append(line)
            if take:
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(d1[take].view(np.int64)),
                        pa.array(d2[take].view(np.int64)),
                        ragged(np.concatenate([keys[at[k] : at[k + 1]] for k in take]).view(np.int64), sizes[take], pa.int64()),
                    ],
                    ["d1", "d2", "keys"],
                )

    return arrow_map(docs.where(F.col("text").isNotNull()).select("text_hash", "text"), make, "d1 long, d2 long, keys array<bigint>")


def _incidence(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Owner and column of the values that two lists or more have, and how many columns there are."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, spot, often = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[spot]
    return owner[column >= 0], column[column >= 0], int((often > 1).sum())


def _shared(lists: list[np.ndarray]) -> np.ndarray:
    """How many values each two lists share, by products of 0/1 rows, a slab of values at a time."""
    owner, column, width = _incidence(lists)
    total = np.zeros((len(lists), len(lists)), np.float32)
    for at in range(0, width, SLAB):
        inside = (column >= at) & (column < at + SLAB)
        rows = np.zeros((len(lists), min(SLAB, width - at)), np.float32)
        rows[owner[inside], column[inside] - at] = 1
        total += rows @ rows.T
    return total


def linked_sets(keys: list[np.ndarray]) -> np.ndarray:
    """Which sets are similar."""
    sizes = np.array([len(k) for k in keys])
    if len(keys) == 2:
        common = np.full((2, 2), len(np.intersect1d(*keys, assume_unique=True)), np.float32)
    else:
        common = _shared(keys)
    linked = 9 * common >= 4 * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    return linked


def _place_key(p: dict) -> tuple:
    return p["null_id"], p["doc_id"] or 0, p["text_hash"], p["line_no"]


def compare(group: pa.Table) -> pa.Table:
    """Links and the earliest linked place of the sets of a cell: components whole, or a chunk or two of a large one."""
    d1, d2, chunk, part = (group[c].to_numpy() for c in ("d1", "d2", "chunk", "component"))
    keys = [k.values.to_numpy().view(U64) for k in group["keys"]]
    places = group["place"].to_pylist()
    across = group["x"][0].as_py() != group["y"][0].as_py()
    seen: dict[tuple, int] = {}
    for k, name in enumerate(zip(part.tolist(), d1.tolist(), d2.tolist())):
        seen.setdefault(name, k)  # several tasks may have given a set
    members: dict[int, list[int]] = {}
    for (component, _, _), k in seen.items():
        members.setdefault(component, []).append(k)
    out = []
    for own in members.values():
        if len(own) < 2:
            continue
        linked = linked_sets([keys[k] for k in own])
        if across:
            linked &= chunk[own][:, None] != chunk[own][None, :]
        links = linked.sum(1)
        if not links.any():
            continue
        order = sorted(range(len(own)), key=lambda k: _place_key(places[own[k]]))
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        best = np.where(linked, rank[None, :], len(own)).min(1)
        out += [(int(d1[own[k]]), int(d2[own[k]]), int(links[k]), places[own[order[best[k]]]]) for k in np.flatnonzero(links).tolist()]
    column = lambda k, kind: pa.array([r[k] for r in out], kind)
    return pa.table({"d1": column(0, pa.int64()), "d2": column(1, pa.int64()), "links": column(2, pa.int64()), "earliest": column(3, group.schema.field("place").type)})


def crowd_levels(classes: DataFrame):
    """A broadcast byte for each of ``COUNTERS`` hashed prefix words, of the word in it that most classes have.

    0: no other class has it; 1: as many as ``CROWD`` have it; above: a step of their number, four for each doubling.
    """
    spark = classes.sparkSession
    prefixes = classes.select("prefix")

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield batch.column("prefix").flatten().to_numpy(zero_copy_only=False).astype(np.int64) & (COUNTERS - 1)

    levels = slot_bytes(prefixes, spots, lambda n: np.where(n > CROWD, 255, n > 1).astype(np.uint8))
    if not (levels == 255).any():
        return spark.sparkContext.broadcast(levels)
    rough = spark.sparkContext.broadcast(levels)

    def perhaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = batch.column("prefix").flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(token[rough.value[token.astype(np.int64) & (COUNTERS - 1)] == 255])], ["token"])

    # Only the words of spots that many prefixes have are counted one by one.
    counted = arrow_map(prefixes, perhaps, "token int").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    step = F.when(F.col("n") <= CROWD, 1).otherwise(F.least(F.lit(255), 2 + F.floor(4 * F.log2("n")))).cast("int")
    spot = F.pmod(F.col("token").cast("long"), F.lit(COUNTERS))
    got = counted.groupBy(spot.alias("spot")).agg(F.max(step).alias("step")).toArrow()  # at most COUNTERS rows
    levels = np.where(levels == 255, 0, levels).astype(np.uint8)
    levels[got["spot"].to_numpy()] = got["step"].to_numpy()
    return spark.sparkContext.broadcast(levels)


def _prefixes(batch: pa.RecordBatch, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix words of the classes of a batch, end to end: class, position in the whole set, word, level."""
    lists = batch.column(batch.schema.get_field_index("prefix"))
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    token = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return owner, at, token, levels[token & (COUNTERS - 1)]


def pairs_by_distance(
    key: np.ndarray, parity: np.ndarray, more: np.ndarray, at: np.ndarray, apart: Callable[[np.ndarray, np.ndarray], np.ndarray], first: bool
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows a and b of one word, in the order of key, that may be similar and that ``apart`` lets pass: one place apart, then two, ...

    Sizes grow along a word's rows, so a row is done as soon as the row k places on is too large for it. With ``first`` a pair
    is looked for at the first word alone that its sets share: then all words before it are in one set only.
    """
    size = key & 0xFFFFFFFF
    room, wide = size - at, size > WIDE
    ahead = (9 * at - size).astype(np.int32)
    reach = np.searchsorted(key, (key >> 32 << 32) + 5 * size // 4, "right") - np.arange(len(key))  # places to the first row that is too large
    a = np.arange(len(key))
    k = 1
    while len(a := a[reach[a] > k]):
        x = a[ahead[a] + ahead[a + k] <= 0] if first else a
        y = x + k
        total = size[x] + size[y]
        some = np.flatnonzero(9 * np.minimum(room[x], room[y]) >= 4 * total)
        some = some[apart(x[some], y[some])]
        x, y = x[some], y[some]
        one, two = parity[x] ^ parity[y], more[x] ^ more[y]
        bits = np.where(wide[x] == wide[y], np.bitwise_count(one).astype(np.int64) + np.bitwise_count(two), np.bitwise_count(one ^ two))
        fit = 9 * bits <= total[some]
        yield x[fit], y[fit]
        k += 1


def near_pairs(key: np.ndarray, d1: np.ndarray, parity: np.ndarray, more: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of one word may be similar, for rows in the order of key (word and size): indices a and b."""
    none = np.zeros(0, np.int64)
    found = [(none, none), *pairs_by_distance(key, parity, more, at, lambda x, y: d1[x] != d1[y], False)]
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def united(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root``, the least node that each node reaches, after the edges (x, y) are added."""
    while (root[x] != root[y]).any():
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root != root[root]).any():
            root = root[root]
    return root


def connected(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what the edges (a, b) connect: from each node to the least one it reaches."""
    nodes, spots = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = united(np.arange(len(nodes)), spots[: len(a)], spots[len(a) :])
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def near_edges(key: np.ndarray, d1: np.ndarray, parity: np.ndarray, more: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (d1) that connect all rows that may be similar, for rows in the order of key.

    What is connected already is not looked at again, and no more than ``PAIRS`` pairs and those of one distance are held.
    """
    names, node = np.unique(d1, return_inverse=True)
    root = np.arange(len(names))
    left, right, held = [], [], 0
    for k, (x, y) in enumerate(pairs_by_distance(key, parity, more, at, lambda x, y: root[node[x]] != root[node[y]], True), 1):
        if len(x):
            left.append(node[x])
            right.append(node[y])
            held += len(x)
        if held > PAIRS or held and k & (k - 1) == 0:
            root = united(root, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
    if held:
        root = united(root, np.concatenate(left), np.concatenate(right))
    far = np.flatnonzero(root != np.arange(len(names)))
    return names[far], names[root[far]]


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones: bytes of small numbers that are zero lie together and compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack_rows(token: np.ndarray, cell: np.ndarray, size: np.ndarray, at: np.ndarray, d1: np.ndarray, parity: np.ndarray, more: np.ndarray) -> bytes:
    """Dealt rows as bytes; ``more`` of sets above ``WIDE`` only, since others have none."""
    return b"".join(
        [len(token).to_bytes(4, "little"), _planes(token), _planes(cell), _planes(size), _planes(at), d1.tobytes(), parity.tobytes(), more[size > WIDE].tobytes()]
    )


def unpack_rows(data: bytes) -> list[np.ndarray]:
    """token, cell, size, at, d1, parity, more as they were packed."""
    n = int.from_bytes(data[:4], "little")
    small = np.frombuffer(data, np.uint8, 16 * n, 4).reshape(4, 4, n).transpose(0, 2, 1)
    columns = list(np.ascontiguousarray(small).view("<u4").reshape(4, n).astype(np.int64))
    d1, parity = np.frombuffer(data, np.int64, n, 4 + 16 * n), np.frombuffer(data, U64, n, 4 + 24 * n)
    more = np.zeros(n, U64)
    more[columns[2] > WIDE] = np.frombuffer(data, U64, -1, 4 + 32 * n)
    return [*columns, d1, parity, more]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b (d1) that connect classes that may be similar, from packed rows in the order of their buckets."""

    def edges(packed: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, cell, size, at, d1, parity, more = (np.concatenate(c) for c in zip(*map(unpack_rows, packed)))
        order = np.lexsort((size, token << 32 | cell))
        token, cell = token[order], cell[order]
        new = np.ones(len(token), np.int64)
        new[1:] = (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])
        a, b = near_edges(np.cumsum(new) << 32 | size[order], d1[order], parity[order], more[order], at[order])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    bucket, packed = None, []
    for batch in batches:
        for of, rows in zip(batch.column("bucket").to_pylist(), batch.column("rows")):
            if of != bucket and packed:
                yield from edges(packed)
                packed = []
            bucket = of
            packed.append(rows.as_py())
    if packed:
        yield from edges(packed)


def candidates(classes: DataFrame) -> DataFrame:
    """Edges a, b that connect classes (d1) that may be similar."""
    classes = classes.where("size(prefix) > 0").select("d1", "size", "parity", "more", "skip", "prefix")
    held = crowd_levels(classes)
    total = classes.agg(F.sum(F.size("prefix").cast("long"))).first()[0] or 0
    buckets, half = 1 + total // BUCKET, max(1, CROWD // 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*kept)]
            kept.clear()
            bucket = (mixed((columns[0] << 32 | columns[1]).view(U64) + U64(GOLDEN)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[order], [c[order] for c in columns]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cuts[1:], len(bucket))
            rows = [pack_rows(*(c[i:j] for c in columns)) for i, j in zip(cuts.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(rows, pa.binary())], ["bucket", "rows"])

        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                owner, at, token, level = _prefixes(batch, held.value)
                take = np.flatnonzero(level > 0)
                owner, at, token, level = owner[take], at[take], token[take] & 0xFFFFFFFF, level[take]
                d1, size, parity, more, skip = (batch.column(c).to_numpy() for c in ("d1", "size", "parity", "more", "skip"))
                # A chunk of a crowded word meets each other one: one row for each of them.
                many = np.where(level > 1, np.minimum(np.ceil(2.0 ** ((level.astype(np.float64) - 1) / 4) / half), 1 << 16), 2).astype(np.int64)
                mine = np.where(level > 1, mixed(d1[owner].view(U64)) % many.astype(U64), 0).astype(np.int64)
                of = np.repeat(np.arange(len(take)), many - 1)
                other = np.arange(len(of)) - np.repeat(np.cumsum(many - 1) - (many - 1), many - 1)
                mine = mine[of]
                other += other >= mine
                cell = np.where(level[of] > 1, np.minimum(mine, other) << 16 | np.maximum(mine, other), 0)
                owner, at, token = owner[of], at[of], token[of]
                if len(of):
                    kept.append([token, cell, size[owner], at + skip[owner], d1[owner], parity[owner].view(U64), more[owner].view(U64)])
                if sum(len(k[0]) for k in kept) >= DEALT:
                    yield packed()
        if kept:
            yield packed()

    dealt = arrow_map(classes, deal, "bucket long, rows binary").repartition("bucket").sortWithinPartitions("bucket")
    return arrow_map(dealt, meet, "a long, b long")


def cells(edges: DataFrame) -> DataFrame:
    """key, x, y, component, chunk, d1: which sets are compared with which, each large component in chunks."""
    labels = components(edges, "families", tidy=True).withColumnRenamed("node", "d1")
    families = materialise(labels.join(labels.groupBy("component").agg(F.count("*").alias("members")), "component"), "labels", tidy=True)
    few = max(1, families.count() // 2_000)
    zero = F.lit(0).cast("long")
    # Small families share cells of about two thousand sets; x = y = -1 keeps them apart from a large family's key.
    alone = F.lit(-1).cast("long")
    small = families.where(F.col("members") <= CHUNK).select(
        F.pmod(F.xxhash64("component"), F.lit(few)).alias("key"), alone.alias("x"), alone.alias("y"), "component", zero.alias("chunk"), "d1"
    )
    chunks = F.ceil(F.col("members") / (CHUNK // 2)).cast("long")
    mine = F.pmod(F.xxhash64("d1"), chunks)
    cell = lambda o: F.struct(F.least(o, mine).alias("x"), F.greatest(o, mine).alias("y"))
    large = families.where(F.col("members") > CHUNK).select(
        F.col("component").alias("key"), F.explode(F.transform(F.sequence(zero, chunks - 1), cell)).alias("cell"), "component", mine.alias("chunk"), "d1"
    )
    return small.unionByName(large.select("key", "cell.*", "component", "chunk", "d1"))


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line that has words: doc_id, text_hash, line_no, class_id, n_links, removed.

    Lines end at newlines; words ignore the case of A-Z. Lines of equal word sets are a class, named by the text
    ``doc_id:line_no`` of its first line; n_links counts the other classes of Jaccard similarity 0.8 or more. A line is
    removed if an earlier line is of its class or of a linked one. Lines are in the order of id (null last), text hash and
    number. Lines without words are never removed and have no row; null and empty texts have none. Rows that repeat share
    their lines' places, so all of them keep a line or none. Other columns play no part. An empty table gives an empty result.
    """
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rare = word_counters(docs)
    table = materialise(line_table(docs, rare), "lines", tidy=True)
    place = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash", "line_no")
    once = [F.max(c).alias(c) for c in ("size", "parity", "more", "skip", "prefix")]  # all that are not null are equal
    classes = materialise(table.groupBy("d1", "d2").agg(F.min(place).alias("place"), F.count("*").alias("lines"), *once), "classes", tidy=True)
    todo = materialise(cells(candidates(classes)).join(classes.select("d1", "d2", "place"), "d1"), "cells", tidy=True)
    compared = todo.join(set_table(docs, todo.select("place"), rare), ["d1", "d2"])
    shape = "d1 long, d2 long, links long, earliest struct<null_id: boolean, doc_id: bigint, text_hash: bigint, line_no: bigint>"
    found = compared.groupBy("key", "x", "y").applyInArrow(compare, shape)
    links = materialise(found.groupBy("d1", "d2").agg(F.sum("links").alias("n_links"), F.min("earliest").alias("earliest")), "links", tidy=True)
    known = classes.select("d1", "d2", "place", "lines").join(links, ["d1", "d2"], "left").select(
        "d1", "d2", F.col("place").alias("first"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.least("place", F.coalesce("earliest", "place")).alias("earliest"), "lines"
    )
    # A class may hold a third of all lines: the most frequent ones come by broadcast, their lines spread over the shuffle.
    names = ["first", "n_links", "earliest"]
    often = known.orderBy(F.desc("lines"), "d1", "d2").limit(HEAVY_LIMIT)
    lines = spread_join(table.select("doc_id", "text_hash", "line_no", "d1", "d2"), known, often, ["d1", "d2"], names, ["text_hash", "line_no"])
    name = F.concat_ws(":", F.coalesce(F.col("first.doc_id").cast("string"), F.lit("null")), F.col("first.line_no"))
    return lines.select("doc_id", "text_hash", "line_no", name.alias("class_id"), "n_links", (F.col("earliest") < place).alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the removed lines of ``found``; other columns as they are. Texts that lose nothing are unchanged.

    The removed lines are stored first, so that what was shuffled to find them is gone when the texts are.
    """
    gone = found.where("removed").groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("_gone"))
    gone = materialise(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_gone"), "gone", tidy=True)
    text = F.col(f"`{text_col}`")
    joined = docs.join(gone, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda _, k: ~F.array_contains(F.col("_gone"), k.cast("long")))
    cleaned = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
