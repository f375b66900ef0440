"""Words of Arrow text columns as numpy arrays, without one Python object per word.

A word is ``[^\\x20\\x09-\\x0D]+``.  Words are told apart by a 64-bit hash of their bytes: two of ten
billion different words meet with a probability of a few in a hundred thousand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that numpy works on at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (a murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Words of up to this many bytes are hashed together, eight bytes at a time.
_SHORT = 64
#: What is left of eight bytes if so many belong to the word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BYTE[SPACE] = 0
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    """Powers of an odd number modulo 2**64."""
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 256), 0x5851F42D4C957F2D, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
    return _powers


@dataclass
class Words:
    """The words of a run of documents; positions are bytes of ``data``."""

    data: np.ndarray  #: bytes of all texts, one after the other
    bounds: np.ndarray  #: where each text starts, and the end
    first: int  #: index of the first document in its Arrow batch
    start: np.ndarray
    end: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    @cached_property
    def doc(self) -> np.ndarray:
        """The document of each word, counted from 0 in this run."""
        return np.searchsorted(self.bounds, self.start, "right") - 1

    @cached_property
    def offsets(self) -> np.ndarray:
        """Where each document's words start among all words, and their number."""
        return np.searchsorted(self.start, self.bounds, "left")

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        table = _BYTE[LOWER] if lower else _BYTE
        begin = self.start[0]
        to_next = np.diff(self.start, append=len(self.data))
        place = np.arange(begin, len(self.data)) - np.repeat(self.start, to_next)
        # Only bytes of words count, and a word may be as long as its document.
        longest = int((self.end - self.start).max())
        np.minimum(place, longest, out=place)
        terms = table[self.data[begin:]]
        terms *= _power_table(longest + 1)[place]
        return mix(np.add.reduceat(terms, self.start - begin))

    def keys(self, lower: bool = False) -> np.ndarray:
        """Hashes as well, others than ``hashes``, eight bytes at a time: in about a quarter of the time."""
        n = len(self.data)
        data = np.zeros((n >> 3) + 2 << 3, np.uint8)
        data[:n] = LOWER[self.data] if lower else self.data
        eight = data.view("<u8")
        at, left = self.start, self.end - self.start
        out = _eight_step(eight, at, left, left.astype(np.uint64) * _STEP)
        more = np.flatnonzero((left > 8) & (left <= _SHORT))
        long = np.flatnonzero(left > _SHORT)
        at, left = at[more], left[more]
        while len(more):
            at, left = at + 8, left - 8
            out[more] = _eight_step(eight, at, left, out[more])
            some = left > 8
            more, at, left = more[some], at[some], left[some]
        for k in long.tolist():
            word = data[self.start[k] : self.end[k]].tobytes()
            out[k] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return out

    def strings(self, which: np.ndarray) -> list[str]:
        """Some of the words as strings."""
        start, length = self.start[which], self.end[which] - self.start[which]
        ends = np.cumsum(length + 1)
        joined = np.full(int(ends[-1]) if len(ends) else 0, 10, np.uint8)  # no word has a line feed
        to = np.arange(int(length.sum())) + np.repeat(np.arange(len(which)), length)
        joined[to] = self.data[np.repeat(start - (ends - length - 1), length) + to]
        return joined.tobytes().decode("utf-8", "replace").split("\n")[:-1]


def _eight_step(eight: np.ndarray, at: np.ndarray, left: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes with up to eight more bytes: those from byte ``at``, of which ``left`` belong to the word."""
    cell, shift = at >> 3, (at & 7).astype(np.uint64) << np.uint64(3)
    # A shift by 64 bits gives 0.
    found = eight[cell] >> shift | eight[cell + 1] << (np.uint64(64) - shift)
    return mix(before ^ found & _MASK[np.minimum(left, 8)])


def chunks(column: pa.Array, breaks: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a text column in runs of whole documents; a null text has none.

    ``breaks``: a lookup of bytes that also end a word; the words are then runs between such bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, "right")) - 1)
        yield split(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at, breaks)
        at = to


def split(data: np.ndarray, bounds: np.ndarray, first: int = 0, breaks: np.ndarray | None = None) -> Words:
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not((SPACE if breaks is None else breaks)[data], out=inside[1:-1])
    fresh = np.zeros(len(data) + 1, bool)  # a document starts here
    fresh[bounds] = True
    is_start = inside[1:] & (fresh | ~inside[:-1])
    is_end = inside[:-1] & (fresh | ~inside[1:])
    return Words(data, bounds, first, np.flatnonzero(is_start), np.flatnonzero(is_end))


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words, by its first word; shorter by ``n - 1``."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _STEP
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if not len(keys):
        return keys[:0], np.empty(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(starts, append=len(keys))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def held_out(id_column: Column, folds: int) -> Column:
    """Whether crc32 of the id as text leaves no remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(id_column.cast("string")) % folds, F.lit(0)) == 0
