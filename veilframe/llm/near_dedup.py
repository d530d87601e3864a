"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. A sketch holds, for each of its registers, the least of the exponential
variables that the set's elements draw for it, as a truncated logarithm: registers of a union are the larger ones, and
two sets agree in a register with a chance close to their Jaccard similarity. Bands of registers give candidates, the
likelihood of the registers' order gives an estimate of the similarity, and what the estimate leaves is compared on the
full sets.

Documents with equal sets are one class from the start. Candidates of a bucket are first compared with the bucket's
smallest class only, and the linked ones are joined into components. Members of a bucket that still lie in different
components are then compared with one another on their full sets, in chunks, and a task returns no more links than join
components. So a group of copies costs its size and not its square, and no link is lost that could join two components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import (
    GOLDEN,
    U64,
    arrow_map,
    components,
    fixed_binary,
    gram_hashes,
    may_hold,
    membership,
    mixed,
    pick,
    ragged,
    slices,
    word_hashes,
    words,
)
from veilframe.session import materialise

REGISTERS = 128
BASE = 1.001
RATE = 20.0
MISS = 1e-6
TOP = 65535


def banding(percent: int, registers: int = REGISTERS) -> tuple[int, int]:
    """Bands and rows of a band: as many rows as let two sets of just that similarity miss all bands with a chance of at most ``MISS``."""
    fitting = [(registers // rows, rows) for rows in range(1, registers + 1) if (1 - (percent / 100) ** rows) ** (registers // rows) <= MISS]
    if not fitting:
        raise ValueError(f"{registers} registers do not suffice for percent={percent}")
    return fitting[-1]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, and how many each text has."""
    starts, ends, owner = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    texts = len(offsets) - 1
    n_words = np.bincount(owner, minlength=texts)
    grams = gram_hashes(hashes, size)
    valid = owner[: len(grams)] == owner[size - 1 :] if len(grams) else np.zeros(0, bool)
    keys, of = grams[valid], owner[: len(grams)][valid]
    first = np.concatenate([[0], np.cumsum(n_words)])
    for t in np.flatnonzero((n_words > 0) & (n_words < size)):  # the whole sequence is the one shingle
        whole = gram_hashes(hashes[first[t] : first[t + 1]], int(n_words[t]))
        keys, of = np.append(keys, mixed(whole + n_words[t].astype(U64))), np.append(of, t)
    counts = np.bincount(of, minlength=texts)
    if len(keys):
        order = np.argsort(of, kind="stable")
        keys, at = keys[order], np.concatenate([[0], np.cumsum(counts)])
        sets = [np.unique(keys[at[t] : at[t + 1]]) for t in range(texts)]
        return np.concatenate(sets), np.array([len(s) for s in sets])
    return keys, counts


def sketches(keys: np.ndarray, counts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers (uint16) of each set; a set without elements has zeros.

    An element's draws for all registers are the first arrivals of a Poisson process of rate RATE * registers whose points
    fall into registers at random. Points are made in rising order up to a limit under which a register of the set is
    hardly ever empty; sets with an empty register are done again with twice the limit.
    """
    out = np.zeros((len(counts), registers), np.uint16)
    todo = np.flatnonzero(counts)
    limit = (math.log(registers) + 3) / (RATE * np.maximum(counts, 1))
    at = np.concatenate([[0], np.cumsum(counts)])
    while len(todo):
        least = np.full(len(todo) * registers, np.inf)
        state = np.concatenate([keys[at[t] : at[t + 1]] for t in todo])
        of = np.repeat(np.arange(len(todo)), counts[todo])
        value = np.zeros(len(state))
        while len(state):
            state = mixed(state + U64(GOLDEN))
            value = value - np.log(((state >> U64(11)) + U64(1)) * 2.0**-53) / (RATE * registers)
            near = value <= limit[todo][of]
            state, of, value = state[near], of[near], value[near]
            np.minimum.at(least, of * registers + (mixed(state ^ U64(GOLDEN)) % U64(registers)).astype(np.int64), value)
        least = least.reshape(len(todo), registers)
        full = np.isfinite(least).all(axis=1)
        out[todo[full]] = np.clip(np.floor(1 - np.log(least[full]) / math.log(BASE)), 0, TOP).astype(np.uint16)
        todo = todo[~full]
        limit[todo] *= 2
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, base: float = BASE) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of each pair of register rows, given the sizes of the sets."""
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - above - below
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)
    up, down = chance(u - v * grid), chance(v - u * grid)
    tiny = 1e-12
    likelihood = above * np.log(up + tiny) + below * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)
    return np.take_along_axis(grid, likelihood.argmax(1)[:, None], 1)[:, 0]


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketch_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n, digest of the set (null without words), registers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            keys, counts = shingle_sets(data, offsets, size)
            at = np.concatenate([[0], np.cumsum(counts)])
            digests = [_digest(keys[at[t] : at[t + 1]]) if counts[t] else None for t in range(len(counts))]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), fixed_binary(sketches(keys, counts))],
                ["doc_id", "text_hash", "n", "digest", "registers"],
            )

    return arrow_map(docs, make, "doc_id long, text_hash long, n long, digest binary, registers binary")


def band_table(classes: DataFrame, percent: int) -> DataFrame:
    """bucket, digest: a row for each band of each class."""
    n_bands, n_rows = banding(percent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            bands = registers[:, : n_bands * n_rows].reshape(batch.num_rows, n_bands, n_rows).astype(U64)
            key = np.broadcast_to(mixed(np.arange(1, n_bands + 1, dtype=U64)), bands.shape[:2])
            for r in range(n_rows):
                key = mixed(key * U64(GOLDEN) + bands[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.T.reshape(-1).view(np.int64)), pa.concat_arrays([batch.column(0)] * n_bands)], ["bucket", "digest"]
            )

    return arrow_map(classes.select("digest", "registers"), make, "bucket long, digest binary")


def set_table(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """digest, keys: the full sets of the wanted digests, a row each."""
    short = lambda c: F.conv(F.substring(F.hex(c), 1, 15), 16, 10).cast("long")  # noqa: E731  60 bits of the digest
    held = membership(wanted.select(short(F.col("digest")).alias("key")), "key")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            keys, counts = shingle_sets(data, offsets, size)
            at = np.concatenate([[0], np.cumsum(counts)])
            digests = [_digest(keys[at[t] : at[t + 1]]) if counts[t] else b"" for t in range(len(counts))]
            spots = np.array([int.from_bytes(d[:8], "big") >> 4 if d else 0 for d in digests], U64)
            take = np.flatnonzero(may_hold(held.value, spots) & (counts > 0))
            if len(take):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([digests[t] for t in take], pa.binary()),
                        ragged(np.concatenate([keys[at[t] : at[t + 1]] for t in take]).view(np.int64), counts[take], pa.int64()),
                    ],
                    ["digest", "keys"],
                )

    found = arrow_map(docs, make, "digest binary, keys array<bigint>")
    return found.groupBy("digest").agg(F.first("keys").alias("keys")).join(wanted, "digest", "left_semi")


def estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is ``least`` or more."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                near = estimate(left, right, batch.column(4).to_numpy().astype(float), batch.column(5).to_numpy().astype(float)) >= least
                yield batch.select([0, 1]).filter(pa.array(near))

    side = lambda x: classes.select(F.col("digest").alias(x), F.col("registers").alias(f"r{x}"), F.col("n").alias(f"n{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")
    return arrow_map(joined, make, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: sets.select(F.col("digest").alias(x), F.col("keys").alias(f"k{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("ka", "kb"))
    return joined.where(100 * common >= percent * (F.size("ka") + F.size("kb") - common)).select("a", "b")


CHUNK = 512
SLAB = 4096


def forest(labels: list, keys: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between members of different labels, as few as join the labels that links join.

    Intersections of all pairs are products of 0/1 rows over the shingles that two members share, a slab of shingles at a time.
    """
    sizes = np.array([len(k) for k in keys])
    shingle, spot, often = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    column = np.where(often > 1, np.cumsum(often > 1) - 1, -1)[spot]
    owner = np.repeat(np.arange(len(keys)), sizes)[column >= 0]
    column = column[column >= 0]
    common = np.zeros((len(keys), len(keys)), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, SLAB):
        inside = (column >= at) & (column < at + SLAB)
        rows = np.zeros((len(keys), SLAB), np.float32)
        rows[owner[inside], column[inside] - at] = 1
        common += rows @ rows.T
    linked = np.triu(100 * common >= percent * (sizes[:, None] + sizes[None, :] - common), 1)
    root = {x: x for x in labels}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = top(labels[i]), top(labels[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def cross_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a bucket and lie in different components, enough to join those components.

    A bucket's members are compared on their full sets in chunks; chunks that hold only the bucket's most frequent component
    are not compared with one another, so that a large group costs its size times the few that are not in it. No pair leaves
    a task unless it is a link that joins something.
    """
    labelled = members.join(labels, members["digest"] == labels["node"], "left").select("bucket", "digest", F.coalesce("component", "digest").alias("label"))
    counts = labelled.groupBy("bucket", "label").count()
    split = (
        counts.groupBy("bucket")
        .agg(F.count("*").alias("labels"), F.sum("count").alias("all"), F.max(F.struct("count", "label")).alias("most"))
        .where("labels > 1")
        .select("bucket", F.col("most.label").alias("main"), F.col("most.count").alias("inner"), (F.col("all") - F.col("most.count")).alias("outer"))
    )
    part = lambda n: F.ceil(F.col(n) / (CHUNK // 2)).cast("long")
    small = F.col("inner") + F.col("outer") <= CHUNK
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    mine = lambda n: F.pmod(F.xxhash64("digest"), part(n))
    cell = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    cells = (
        F.when(small, F.array(cell(F.lit(0), F.lit(0))))
        .when(F.col("label") == F.col("main"), F.transform(numbers(part("outer")), lambda o: cell(o, part("outer") + mine("inner"))))
        .otherwise(
            F.concat(
                F.transform(numbers(part("outer")), lambda o: cell(F.least(o, mine("outer")), F.greatest(o, mine("outer")))),
                F.transform(numbers(part("inner")), lambda i: cell(mine("outer"), part("outer") + i)),
            )
        )
    )
    open_ = labelled.join(split, "bucket").select("bucket", "digest", "label", F.explode(cells).alias("cell")).select("bucket", "digest", "label", "cell.*")
    held = materialise(open_, "open").join(sets, "digest").select("bucket", "x", "y", "digest", "label", "keys")

    def compare(group: pa.Table) -> pa.Table:
        digests, labels = group["digest"].to_pylist(), group["label"].to_pylist()
        found = []
        if len(set(labels)) > 1:
            found = forest(labels, [k.values.to_numpy().view(U64) for k in group["keys"]], percent)
        return pa.table({"a": pa.array([digests[i] for i, _ in found], pa.binary()), "b": pa.array([digests[j] for _, j in found], pa.binary())})

    return held.groupBy("bucket", "x", "y").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, chosen for every row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; a component is what links
    reach, named by its smallest id, and the document of that id is kept. A text without words (null, empty, white space)
    has no set, is linked with nothing and is its own component. Rows that repeat are one class and stay rows; among rows
    with the same id and similar texts all are kept. A null id counts only where no other id is in the component; then the
    component is null. ``chosen`` marks one text of each component, whatever its ids: that of the smallest id (null last) and text
    hash; rows without words are all chosen. Other columns play no part. An empty table gives an empty result. Two linked sets share no band with a
    chance of at most ``MISS``; a ``percent`` too low for that is refused.
    """
    banding(percent)
    docs = pick(docs, doc_id=id_col, text=text_col)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    table = materialise(sketch_table(docs, shingle), "sketches")
    name = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "text_hash")
    classes = materialise(
        table.where("n > 0").groupBy("digest").agg(F.min(name).alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers")),
        "classes",
    )
    bands = band_table(classes, percent)
    buckets = bands.groupBy("bucket").agg(F.min("digest").alias("leader"), F.count("*").alias("members")).where("members > 1")
    members = materialise(bands.join(buckets, "bucket").select("bucket", "digest", "leader"), "members")
    sets = materialise(set_table(docs.select("text"), members.select("digest").distinct(), shingle), "sets")

    margin = percent / 100 - 5 * math.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    stars = materialise(members.where("digest <> leader").select(F.col("leader").alias("a"), F.col("digest").alias("b")).distinct(), "stars")
    links = materialise(verified(estimated(stars, classes, margin), sets, percent), "links")
    first = components(links, "components")
    more = cross_links(members.select("bucket", "digest"), first, sets, percent)
    final = components(links.unionByName(more), "components")

    named = classes.join(final, classes["digest"] == final["node"], "left").select(
        "digest", "least", F.coalesce("component", "digest").alias("component")
    )
    lowest = named.groupBy("component").agg(F.min("least").alias("least"))
    names = named.drop("least").join(lowest, "component").select("digest", "least")
    placed = table.drop("registers").join(names, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    chosen = (F.col("n") == 0) | F.col("least").eqNullSafe(name)
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", chosen.alias("chosen"))
