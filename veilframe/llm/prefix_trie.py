"""The trie of conversation prefixes, from minimal-perfect-hash node tables.

A node is a distinct sequence of first turns, named by a 128-bit digest that continues its parent's. Nodes that many
conversations share form the spine: by the limit that makes a node heavy there are at most ``SPINE_NODES`` of them. Below the
spine hang subtrees of few conversations each, which are dealt to shards whole. A shard enumerates its distinct digests,
gives each a slot by a minimal perfect hash, scatters counts into flat arrays by slot, and sums subtrees from the deepest level
up through an array of parent slots. The spine is one more such table, with what hangs below it added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import GOLDEN, U64, arrow_map, mixed
from veilframe.session import materialise

SPINE_NODES = 1 << 20
HEAVY = 256
SHARD_CONVERSATIONS = 1 << 13
ROOT = (0x243F6A8885A308D3, 0x13198A2E03707344)
PIECE_BYTES = 1 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

_NODE = "hi long, lo long, parent_hi long, parent_lo long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
_COUNTS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


class SlotTable:
    """A minimal perfect hash of distinct 128-bit digests, by cascading bit arrays.

    Each level hashes the digests that are left into an array half as long again; those alone at their place stay there, the
    others go to the next level. A slot is the rank of its place. The digests lie in their slots, and every lookup is compared.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.places: list[np.ndarray] = []
        left, slot = np.arange(len(hi)), np.full(len(hi), -1, np.int64)
        taken = 0
        while len(left):
            if len(self.places) > 200:
                raise ValueError("the digests are not distinct")
            at = self._place(hi[left], lo[left], len(self.places), max(8, len(left) + len(left) // 2))
            seen = np.bincount(at, minlength=max(8, len(left) + len(left) // 2))
            place = np.where(seen == 1, taken - 1 + np.cumsum(seen == 1), -1)
            self.places.append(place)
            slot[left] = place[at]
            taken += int((seen == 1).sum())
            left = left[place[at] < 0]
        self.hi, self.lo = np.empty_like(hi), np.empty_like(lo)
        self.hi[slot], self.lo[slot] = hi, lo

    def __len__(self) -> int:
        return len(self.hi)

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(lo ^ mixed(hi + U64(((level + 1) * GOLDEN) & (1 << 64) - 1))) % U64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for those that the table does not hold."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for level, place in enumerate(self.places):
            got = place[self._place(hi[left], lo[left], level, len(place))]
            out[left[got >= 0]] = got[got >= 0]
            left = left[got < 0]
        held = out >= 0
        held[held] = (self.hi[out[held]] == hi[held]) & (self.lo[out[held]] == lo[held])
        return np.where(held, out, -1)


def distinct(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where each distinct digest is first found."""
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    return order[new]


def accumulate(depth: np.ndarray, parent: np.ndarray, *values: np.ndarray) -> None:
    """Add every node's values to its parent's slot, the deepest nodes first; nodes without a parent here have slot -1."""
    order = np.argsort(-depth, kind="stable")
    order = order[parent[order] >= 0]
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        for value in values:
            np.add.at(value, parent[level], value[level])


def chained(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all prefixes from the digests of the turns, sequences end to end."""
    out_hi, out_lo = np.empty_like(hi), np.empty_like(lo)
    order = np.argsort(-counts, kind="stable")
    begin, sizes = (np.cumsum(counts) - counts)[order], counts[order]
    a, b = np.full(len(order), ROOT[0], U64), np.full(len(order), ROOT[1], U64)
    for d in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -d, "left"))  # sequences of more than d turns
        at = begin[:n] + d
        a, b = mixed(a[:n] * U64(GOLDEN) + mixed(hi[at] ^ b[:n])), mixed(b[:n] + mixed(lo[at] + U64(GOLDEN)) ^ a[:n])
        out_hi[at], out_lo[at] = a, b
    return out_hi, out_lo


def turn_sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns (hi, lo, size) of every conversation, in the order of the turns, null first.

    A turn is named by 128 bits of hash over role and text, null ones being empty; size is the text's UTF-8 bytes. Turns of equal
    number are ordered by these bits. Rows without a conversation id take no part. Only hashes are shuffled, and a
    conversation's hashes (24 bytes a turn) are held by one task. Other columns play no part.
    """
    name = lambda c: F.col(f"`{c}`")
    role, text = (F.coalesce(name(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.struct(
        name(turn_col).isNotNull().alias("known"),
        F.coalesce(name(turn_col).cast("long"), F.lit(0)).alias("number"),
        F.xxhash64(F.lit(1), role, text).alias("hi"),
        F.xxhash64(F.lit(2), text, role).alias("lo"),
        F.octet_length(text).cast("long").alias("size"),
    )
    rows = conversations.select(name(id_col).cast("long").alias("conv_id"), turn.alias("turn")).where("conv_id IS NOT NULL")
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["size"].alias("size"))).alias("turns"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hi, lo and size of all entries end to end, and how many each row has."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    parts = column.flatten()
    hi, lo, size = (parts.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return hi.astype(np.int64).view(U64), lo.astype(np.int64).view(U64), size.astype(np.int64), counts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _list_array(counts: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.Array:
    entries = pa.StructArray.from_arrays([_signed(hi), _signed(lo), pa.array(size, pa.int64())], ["hi", "lo", "size"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), entries)


_ENTRIES = "array<struct<hi: long, lo: long, size: long>>"


def prefix_paths(sequences: DataFrame) -> DataFrame:
    """conv_id, the node each sequence ends in (end_hi, end_lo), n_turns, and nodes, its prefixes from one turn on; stored."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, size, counts = _lists(batch.column(1))
            hi, lo = chained(hi, lo, counts)
            last = np.cumsum(counts) - 1
            some = counts > 0
            ends = [np.where(some, x[last] if len(x) else root, U64(root)) for x, root in zip((hi, lo), ROOT)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(_signed, ends), pa.array(counts, pa.int64()), _list_array(counts, hi, lo, size)],
                ["conv_id", "end_hi", "end_lo", "n_turns", "nodes"],
            )

    made = arrow_map(sequences.select("conv_id", "turns"), make, f"conv_id long, end_hi long, end_lo long, n_turns long, nodes {_ENTRIES}")
    return materialise(made, "paths")


def _node_batch(table: SlotTable, parent_hi, parent_lo, conv, depth, parent, n_convs, children, leaves, saved) -> pa.RecordBatch:
    inside = parent >= 0
    return pa.RecordBatch.from_arrays(
        [
            *map(_signed, (table.hi, table.lo, parent_hi, parent_lo)),
            *(pa.array(x, pa.int64()) for x in (conv, depth)),
            pa.array(conv[parent], pa.int64(), mask=~inside) if len(conv) else pa.array([], pa.int64()),
            *(pa.array(x, pa.int64()) for x in (n_convs, children, leaves, saved)),
            pa.array(~inside),
        ],
        [part.split()[0] for part in _NODE.split(", ")],
    )


def _subtrees(rows: pa.Table) -> pa.Table:
    """The nodes of a shard: whole subtrees, a row of ``rows`` for each conversation in them."""
    hi, lo, size, counts = _lists(rows["nodes"])
    begin = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    above_hi, above_lo = np.empty_like(hi), np.empty_like(lo)
    above_hi[1:], above_lo[1:] = hi[:-1], lo[:-1]
    above_hi[begin], above_lo[begin] = column("parent_hi").view(U64), column("parent_lo").view(U64)
    first = distinct(hi, lo)
    table = SlotTable(hi[first], lo[first])
    n = len(table)
    slot = table.slots(hi, lo)
    if (slot < 0).any():
        raise ValueError("a digest without a slot")
    n_convs = np.bincount(slot, minlength=n)
    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, slot, column("conv_id")[of])
    depth, bytes_of, parent_hi, parent_lo = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, U64), np.empty(n, U64)
    depth[slot] = column("above")[of] + 1 + np.arange(len(of)) - begin[of]
    bytes_of[slot], parent_hi[slot], parent_lo[slot] = size, above_hi, above_lo
    parent = table.slots(parent_hi, parent_lo)
    children = np.bincount(parent[parent >= 0], minlength=n)
    leaves, saved = (children == 0).astype(np.int64), (n_convs - 1) * bytes_of
    accumulate(depth, parent, leaves, saved)
    return pa.Table.from_batches([_node_batch(table, parent_hi, parent_lo, conv, depth, parent, n_convs, children, leaves, saved)])


def _spine(rows: pa.Table) -> pa.Table:
    """The nodes of the spine, with the totals of what hangs below each in ``add_children``, ``add_leaves`` and ``add_saved``."""
    column = lambda name: rows[name].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    hi, lo = column("hi").view(U64), column("lo").view(U64)
    table = SlotTable(hi, lo)
    at = np.empty(len(hi), np.int64)
    at[table.slots(hi, lo)] = np.arange(len(hi))
    by_slot = lambda name: column(name)[at]
    parent_hi, parent_lo = by_slot("parent_hi").view(U64), by_slot("parent_lo").view(U64)
    depth, n_convs = by_slot("depth"), by_slot("n_convs")
    parent = np.where(depth > 0, table.slots(parent_hi, parent_lo), -1)
    children = by_slot("add_children") + np.bincount(parent[parent >= 0], minlength=len(hi))
    leaves = by_slot("add_leaves") + (children == 0)
    saved = by_slot("add_saved") + (n_convs - 1) * by_slot("size")
    accumulate(depth, parent, leaves, saved)
    return pa.Table.from_batches([_node_batch(table, parent_hi, parent_lo, by_slot("conv_id"), depth, parent, n_convs, children, leaves, saved)])


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``paths`` (see ``prefix_paths``), which is stored.

    hi, lo (the node's digest), parent_hi, parent_lo, conv_id (the smallest of its members), depth, parent_conv_id (null at the
    root), n_convs (members), n_children, n_leaves (childless nodes of its subtree) and saved_tokens (over its subtree, members
    but one times the bytes of the node's last turn). The root has no text; without conversations there is no row. Equal
    conversations share all nodes; a conversation without turns is a member of the root alone. Null texts, repeated rows and
    other columns are dealt with by ``turn_sequences``.
    """
    spark = paths.sparkSession
    n_convs, n_rows = paths.agg(F.count("*"), F.coalesce(F.sum("n_turns"), F.lit(0))).first()
    if not n_convs:
        return spark.createDataFrame([], _NODE).drop("top")
    least = max(HEAVY, -(-n_rows // SPINE_NODES))  # so that at most SPINE_NODES nodes are heavier
    counted = paths.select(F.explode("nodes").alias("e")).select("e.hi", "e.lo").groupBy("hi", "lo").count()
    heavy = counted.where(F.col("count") > least).select("hi", "lo").toArrow()  # at most SPINE_NODES rows
    keys = [heavy[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for c in ("hi", "lo")]
    known = spark.sparkContext.broadcast(SlotTable(*keys))
    shards = max(64, -(-n_convs // SHARD_CONVERSATIONS))

    def split(batch: pa.RecordBatch):
        """Entries of the paths, and how many of each path's nodes belong to the spine: a prefix, as members only get fewer."""
        hi, lo, size, counts = _lists(batch.column(batch.schema.get_field_index("nodes")))
        owner = np.repeat(np.arange(len(counts)), counts)
        on_spine = np.bincount(owner[known.value.slots(hi, lo) >= 0], minlength=len(counts))
        return hi, lo, size, counts, owner, on_spine

    def spine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, size, counts, owner, on_spine = split(batch)
            conv = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
            held = np.flatnonzero(place < on_spine[owner])
            above = np.maximum(held - 1, 0)
            top = place[held] == 0
            parents = [np.where(top, U64(root), x[above]) for x, root in zip((hi, lo), ROOT)]
            # The root is a row of every path.
            root = [np.full(len(conv), r, U64) for r in ROOT]
            zero = np.zeros(len(conv), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *(_signed(np.concatenate([a, b])) for a, b in ((hi[held], root[0]), (lo[held], root[1]), (parents[0], root[0]), (parents[1], root[1]))),
                    *(pa.array(np.concatenate(x), pa.int64()) for x in ((place[held] + 1, zero), (size[held], zero), (conv[owner[held]], conv))),
                ],
                ["hi", "lo", "parent_hi", "parent_lo", "depth", "size", "conv_id"],
            )

    def light_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, size, counts, owner, on_spine = split(batch)
            begin = np.cumsum(counts) - counts
            some = np.flatnonzero(counts > on_spine)
            if not len(some):
                continue
            first = begin[some] + on_spine[some]
            place = np.arange(len(owner)) - begin[owner]
            rest = place >= on_spine[owner]
            above = np.maximum(first - 1, 0)
            parents = [np.where(on_spine[some] == 0, U64(root), x[above]) for x, root in zip((hi, lo), ROOT)]
            shard = (mixed(hi[first] + U64(GOLDEN)) % U64(shards)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard, pa.int64()),
                    batch.column(0).take(pa.array(some)),
                    *map(_signed, parents),
                    pa.array(on_spine[some], pa.int64()),
                    _list_array((counts - on_spine)[some], hi[rest], lo[rest], size[rest]),
                ],
                ["shard", "conv_id", "parent_hi", "parent_lo", "above", "nodes"],
            )

    rows = paths.select("conv_id", "nodes")
    spine = (
        arrow_map(rows, spine_rows, "hi long, lo long, parent_hi long, parent_lo long, depth long, size long, conv_id long")
        .groupBy("hi", "lo")
        .agg(*[F.min(c).alias(c) for c in ("parent_hi", "parent_lo", "depth", "size", "conv_id")], F.count("*").alias("n_convs"))
    )
    light = arrow_map(rows, light_rows, f"shard long, conv_id long, parent_hi long, parent_lo long, above long, nodes {_ENTRIES}")
    below = materialise(light.groupBy("shard").applyInArrow(_subtrees, _NODE), "subtrees")
    added = (
        below.where("top")
        .groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo"))
        .agg(F.count("*").alias("add_children"), F.sum("n_leaves").alias("add_leaves"), F.sum("saved_tokens").alias("add_saved"))
    )
    # One table of at most SPINE_NODES nodes and the root, whatever the input.
    crown = materialise(spine.join(added, ["hi", "lo"], "left").fillna(0).groupBy(F.lit(0).alias("_all")).applyInArrow(_spine, _NODE), "spine")
    above = crown.select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("_above"))
    names = ["hi", "lo", "parent_hi", "parent_lo"]
    hung = below.where("top").drop("parent_conv_id").join(F.broadcast(above), ["parent_hi", "parent_lo"]).withColumnRenamed("_above", "parent_conv_id")
    parts = [df.select(*names, *_COUNTS) for df in (crown, below.where("NOT top"), hung)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ends_digests(paths: DataFrame) -> DataFrame:
    """hi, lo, ends_sha256: for each node that conversations end in, the SHA-256 of their ids, ascending, comma-joined.

    Ids are sorted over ranges. A node within one range is hashed there; one that crosses a border, or is long, leaves joined
    pieces, and these are hashed one after another as they stream by.
    """
    ends = paths.select(F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id")
    ordered = ends.repartitionByRange("hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        node, first, held, size, whole = None, 0, [], 0, False

        def close(complete: bool) -> None:
            if not held:  # all of it has left as pieces
                return
            text = ",".join(held)
            out.append((*node, first, None if complete else text, hashlib.sha256(text.encode()).hexdigest() if complete else None))

        def flushed() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out)) or [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["hi", "lo", "first", "piece", "ends_sha256"])
            out.clear()
            return batch

        for batch in batches:
            for hi, lo, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) != node:
                    if node is not None:
                        close(whole)
                    # The first node of a range may have begun in the one before.
                    whole, node, held, size = node is not None, (hi, lo), [], 0
                if not held:
                    first = conv
                held.append(str(conv))
                size += len(held[-1]) + 1
                if size >= PIECE_BYTES:
                    whole = False
                    close(False)
                    held, size = [], 0
            yield flushed()
        close(False)  # the last node may go on in the next range
        yield flushed()

    parts = materialise(arrow_map(ordered, make, "hi long, lo long, first long, piece string, ends_sha256 string"), "ends")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names, kinds = ["hi", "lo", "ends_sha256"], (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = []
            for hi, lo, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) == node:
                    state.update(b"," + piece.encode())
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (hi, lo), hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, kinds)], names)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*node, state.hexdigest()), kinds)], names)

    pieces = parts.where("piece IS NOT NULL").repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first").select("hi", "lo", "piece")
    crossing = arrow_map(pieces, finish, "hi long, lo long, ends_sha256 string")
    return parts.where("ends_sha256 IS NOT NULL").select("hi", "lo", "ends_sha256").unionByName(crossing)
