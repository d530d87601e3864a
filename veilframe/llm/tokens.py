"""Token ids of whole texts, with each distinct piece of text between white space encoded once for a slice of texts.

The byte-level vocabulary never joins a token across a change from non-space to white space, so that a text's ids are the
ids of its units end to end; a unit is a run of white space and the run without white space after it. Most units of a slice
repeat. The distinct ones are encoded together as one string and told apart by the byte lengths of the tokens.

The vocabulary file is one of the ``tokenizers`` library. It is read into a ``tiktoken`` encoding, which gives the same ids
several times faster; the tests hold both against each other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from veilframe.llm.common import BYTE_CODES, SPACE, slices, span_hashes

SLICE_BYTES = 2 << 20
#: Bytes of a unit above which ``tokenizers`` encodes it: the other library's pattern fails on a million white spaces in a row.
LONG_UNIT = 100_000
#: Fixed value: how the byte-level vocabulary splits text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def no_space(data: np.ndarray) -> np.ndarray:
    """Whether a byte surely ends a character that is no white space; bytes that may end one beyond ASCII are not sure."""
    one, two = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    one[1:], two[2:] = data[:-1], data[:-2]
    unsure = (one == 0xC2) & ((data == 0x85) | (data == 0xA0)) | (two >= 0xE1) & (two <= 0xE3)
    return ~SPACE[data] & ((data < 0x80) | ~unsure)


def unit_starts(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Where units start: at each text and at each ASCII white space that surely follows a non-space character."""
    begins = np.zeros(len(data), bool)
    begins[1:] = SPACE[data[1:]] & solid[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(begins)


def spans_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of spans, end to end."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def byte_symbols() -> dict[str, int]:
    """The vocabulary file writes bytes as printable characters: Latin-1 where that is printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of slices of texts by a byte-level vocabulary file of the ``tokenizers`` library."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        symbols = byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        for k, merge in enumerate(content["model"]["merges"]):
            if content["model"]["vocab"]["".join(merge if isinstance(merge, list) else merge.split(" "))] != 256 + k:
                raise ValueError("the ids of the vocabulary do not follow its merges")
        self.path, self._library = path, None
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = len(token)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def long(self, text: str) -> np.ndarray:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.asarray(self._library.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: str) -> np.ndarray:
        if len(text) > LONG_UNIT:  # no more characters than bytes
            return self.long(text)
        return self._short(text)

    def _short(self, text: str) -> np.ndarray:
        """Of text without very long runs of white space."""
        return np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), np.uint32)

    def _of_units(self, data: np.ndarray, solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given units end to end, and the number of ids of each."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Units that may stand in one string: white space starts them, and no white space ends them. Others stay alone.
        length = ends - starts
        together = SPACE[data[starts]] & solid[ends - 1] & (length <= LONG_UNIT)
        joined = self._short(data[spans_of(starts[together], length[together])].tobytes().decode())
        sizes = np.zeros(len(starts), np.int64)
        sizes[together] = np.diff(np.searchsorted(np.cumsum(self.bytes_of[joined]), np.cumsum(length[together]), "right"), prepend=0)
        alone = {k: self.plain(data[starts[k] : ends[k]].tobytes().decode()) for k in np.flatnonzero(~together).tolist()}
        for k, ids in alone.items():
            sizes[k] = len(ids)
        out = np.empty(sizes.sum(), np.uint32)
        out[np.repeat(together, sizes)] = joined
        if alone:
            out[np.repeat(~together, sizes)] = np.concatenate(list(alone.values()))
        return out, sizes

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers of the distinct units; which of them each unit of the texts is, and its text."""
        solid = no_space(data)
        starts = unit_starts(data, offsets, solid)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        _, example, which = np.unique(span_hashes(BYTE_CODES[data], starts, ends), return_index=True, return_inverse=True)
        ids, sizes = self._of_units(data, solid, starts[example], ends[example])
        return ids, sizes, which, np.searchsorted(offsets, starts, "right") - 1

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        _, sizes, which, owner = self.units(data, offsets)
        return np.bincount(owner, sizes[which], len(offsets) - 1).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and the number of ids of each text."""
        ids, sizes, which, owner = self.units(data, offsets)
        first, each = (np.cumsum(sizes) - sizes)[which], sizes[which]
        return ids[spans_of(first, each)], np.bincount(owner, each, len(offsets) - 1).astype(np.int64)


def encoder_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    return slices(batches, limit=SLICE_BYTES)
