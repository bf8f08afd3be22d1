"""Vectorised word and line splitting over Arrow string batches.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``. Every byte of a
multi-byte code point is above 0x7F, so splitting the UTF-8 bytes and splitting
the code points agree. Hashes are 64-bit and depend on nothing but the bytes,
hence they are the same in every task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True
#: Everything in ASCII but letters and digits.
BREAK = np.ones(256, bool)
BREAK[48:58] = BREAK[65:91] = BREAK[97:123] = BREAK[0x80:] = False
CONTINUATION = np.zeros(256, bool)
CONTINUATION[0x80:0xC0] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of text handled at once; numpy's temporaries are about 60 times that.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs get unrelated outputs."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= MIX1
    x ^= x >> U64(27)
    x *= MIX2
    x ^= x >> U64(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U64) * BASE)


_give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trim() -> None:
    """Gives memory that is free in this worker back to the system, as workers live from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _give_back:
        _give_back(0)


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most ``most`` bytes of text each, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each closed by a newline, and where each starts (one more entry: the end)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    sizes = np.asarray(pc.binary_length(column)).astype(np.int64) + 1
    starts = np.concatenate(([0], np.cumsum(sizes)))
    closed = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    return np.frombuffer(closed.buffers()[2] or b"", np.uint8, int(starts[-1])), starts


class Runs:
    """Runs between separators: ``starts``, ``ends`` (bytes), ``doc`` (row of the batch), ``hash``, and in ``prefixes``
    for each of some lengths the hash of a run's first so many bytes."""

    def __init__(self, data: np.ndarray, doc_starts: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = LOWER, prefixes: tuple[int, ...] = ()):
        parts, at = [], 0
        while at < len(data):  # pieces end at a separator, so no run is cut
            to = min(len(data), at + CHUNK)
            if to < len(data):
                cut = np.flatnonzero(separators[data[at:to]])
                if len(cut):
                    to = at + int(cut[-1]) + 1
                else:
                    more = np.flatnonzero(separators[data[to:]])
                    to = to + int(more[0]) + 1 if len(more) else len(data)
            parts.append(self._split(data[at:to], at, separators, fold, prefixes))
            at = to
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, U64)] * (1 + len(prefixes)))
        self.starts, self.ends, self.hash, *self.prefixes = (np.concatenate(x) for x in zip(*parts or [empty], strict=True))
        self.doc = np.searchsorted(doc_starts, self.starts, "right") - 1

    @staticmethod
    def _split(data: np.ndarray, shift: int, separators: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...]):
        inside = ~separators[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0, np.int64), *[np.empty(0, U64)] * (1 + len(prefixes))
        sizes = ends - starts
        firsts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
        power = np.full(int(sizes.max()), BASE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        values = BYTE[fold[data[inside]]] * power[place]
        hashes = np.add.reduceat(values, firsts)
        heads = [mix(np.add.reduceat(values * (place < k), firsts) ^ np.array([k], U64) * MIX2) for k in prefixes]
        return starts + shift, ends + shift, mix(hashes ^ (sizes.astype(U64) * MIX1)), *heads


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-run window that lies inside one document, and where it begins."""
    many = len(hashes) - n + 1
    if many <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    out = np.zeros(many, U64)
    for k in range(n):
        out = out * BASE + hashes[k : k + many]
    at = np.flatnonzero(doc[:many] == doc[n - 1 :])
    return mix(out[at]), at


def per_doc(doc: np.ndarray, docs: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, docs).astype(np.int64)


def repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run: has its document the same run anywhere else; has it the same run earlier."""
    key = mix(hashes ^ mix(doc.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, again


class Places:
    """Numbers distinct 64-bit hashes in the order in which they are added: a hash table in two arrays."""

    def __init__(self):
        self.size, self.keys, self.numbers = 0, np.zeros(1 << 16, U64), np.empty(1 << 16, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 for those not there."""
        out, todo, mask = np.full(len(hashes), -1, np.int32), np.arange(len(hashes)), U64(len(self.keys) - 1)
        at = (hashes & mask).astype(np.int64)
        while len(todo):
            there = self.keys[at]
            same = there == hashes[todo]
            out[todo[same]] = self.numbers[at[same]]
            on = ~same & (there != 0)
            todo, at = todo[on], at[on] + 1 & len(self.keys) - 1
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Adds hashes that are distinct and not there."""
        if 2 * (self.size + len(hashes)) > len(self.keys):
            old, numbers = self.keys, self.numbers
            big = 1 << (4 * (self.size + len(hashes))).bit_length()
            self.keys, self.numbers = np.zeros(big, U64), np.empty(big, np.int32)
            self._put(old[old != 0], numbers[old != 0])
        self._put(hashes, np.arange(self.size, self.size + len(hashes), dtype=np.int32))
        self.size += len(hashes)

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        at = (hashes & U64(len(self.keys) - 1)).astype(np.int64)
        while len(at):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            mine = free & (self.keys[at] == hashes)  # where several wanted a place, the last has it
            self.numbers[at[mine]] = numbers[mine]
            hashes, numbers, at = hashes[~mine], numbers[~mine], at[~mine] + 1 & len(self.keys) - 1
