"""Adaptive context-mixing range coder for token ids, in blocks of their own.

Each id is predicted from the one and the two before it (orders 1 and 2): hashed tables hold
the id last seen in a context and how far it may be trusted, and a logistic mixer with weights
learned on the way turns the trust of both into the probability that the better prediction
is right. Otherwise the id's bit length is coded under order-0 frequencies that are renewed
as the block goes on, and its lower bits follow as they are. A carry-less range coder does the coding.

Every block starts from nothing and has a CRC of its ids. Many blocks are coded in step, one lane of
each numpy array a block, and all arithmetic is on integers, so a block reads the same anywhere.

A block: five little-endian unsigned 32-bit numbers (ids, CRC-32 of the ids as such numbers,
range-coder words, raw words, wide ids), then the words, 16 bits each, and the wide ids, 32 bits each: those from WIDE on, which
are coded as WIDE.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

#: Ids in a block, slots of a context table, steps between renewals of the order-0 frequencies.
BLOCK, SLOTS, RENEW = 2048, 1024, 128
CLASSES = 17
#: What stands for ids that don't fit 16 bits.
WIDE = 65_535
_I, _N, _U, _E, _F = np.int64, np.int32, np.uint64, np.uint32, np.float64
_TOP, _LOW32, _MASK48 = _U(32), _U((1 << 32) - 1), _U((1 << 48) - 1)
STRETCH = np.array([max(-2047, min(2047, round(256 * math.log((i + 0.5) / (4095.5 - i))))) for i in range(4096)], _N)
SQUASH = np.array([max(1, min(4095, round(4096 / (1 + math.exp(-i / 256))))) for i in range(-2047, 2048)], _N)
LENGTH = np.array([i.bit_length() for i in range(1 << 16)], _N)


class _Model:
    """What encoder and decoder do alike, for every lane: predict, then learn the id."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        # of both orders, one after the other
        self.row = np.arange(2 * lanes, dtype=_I).reshape(2, lanes) * SLOTS
        self.table = np.zeros(2 * lanes * SLOTS, _E)  # id << 16 | trust
        self.weight = np.repeat(np.array([[32768], [49152]], _N), lanes, axis=1)
        self.slot = np.empty((2, lanes), _E)
        self.counts = np.zeros(lanes * CLASSES, _N)
        self.count_row = np.arange(lanes, dtype=_I) * CLASSES
        self.cum_row = np.arange(lanes, dtype=_I) * (CLASSES + 1)
        self.spread, self.spread_before = np.zeros(lanes, _E), np.zeros(lanes, _E)  # the last id's hash and the one's before
        self.step = 0

    def predict(self) -> None:
        if self.step % RENEW == 0:
            counts = self.counts.reshape(self.lanes, CLASSES)
            share = 1 + counts * (256 - CLASSES) // np.maximum(counts.sum(axis=1, keepdims=True), 1)
            share[np.arange(self.lanes), counts.argmax(axis=1)] += 256 - share.sum(axis=1)
            cum = np.zeros((self.lanes, CLASSES + 1), _N)
            np.cumsum(share, axis=1, out=cum[:, 1:])
            self.cum, self.share = cum.ravel(), share
            self.counts //= 2
        self.step += 1
        np.right_shift(self.spread, 4, out=self.slot[0])
        np.right_shift(self.spread + self.spread_before * _E(3), 5, out=self.slot[1])
        self.slot &= SLOTS - 1
        self.at = self.row + self.slot
        self.entry = self.table.take(self.at)
        self.trust, self.was = self.entry & 0xFFFF, self.entry >> 16
        self.guess = np.where(self.trust[1] >= self.trust[0], self.was[1], self.was[0])
        self.told = STRETCH.take(self.trust >> 4) * (self.was == self.guess)
        mixed = self.weight * self.told
        mixed = (mixed[0] + mixed[1]) >> 16
        mixed += 2047
        self.p = SQUASH.take(mixed, mode="clip")
        self.hit_size = self.p * _N(15) + _N(32)

    def learn(self, ids: np.ndarray, hit: np.ndarray, length: np.ndarray) -> None:
        error = (hit << 12) - self.p
        self.weight += (self.told * error) >> 11
        if self.step % 16 == 0:  # they can't leave 32 bits in between
            np.clip(self.weight, -65536, 262144, out=self.weight)
        wrong = np.where(self.trust < 16384, ids << 16 | 6144, self.entry - (self.trust >> 2))
        self.table[self.at] = np.where(self.was == ids, self.entry + (65535 - self.trust >> 3), wrong)
        missed = np.flatnonzero(hit == 0)
        self.counts[self.count_row[missed] + length[missed]] += 24
        self.spread_before, self.spread = self.spread, ids * _E(40503)


def encode(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The blocks of a sequence of ids."""
    ids = np.ascontiguousarray(ids, _I)
    if not len(ids):
        return []
    if ids.min() < 0 or ids.max() >= 1 << 32:
        raise ValueError("ids must be 32-bit numbers, not negative")
    whole, ids = ids, np.minimum(ids, WIDE)
    lanes, steps = -(-len(ids) // block), min(block, len(ids))
    grid = np.zeros((lanes, steps), _I)
    grid.ravel()[: len(ids)] = ids
    by_step = np.ascontiguousarray(grid.T.astype(_E))
    model, literal = _Model(lanes), np.empty((steps, lanes), bool)
    words, used = np.zeros(lanes * (2 * steps + 8), np.uint16), np.arange(lanes, dtype=_I) * (2 * steps + 8)
    first = used.copy()
    low, size = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    for t in range(steps):
        now = by_step[t]
        model.predict()
        right = now == model.guess
        hit, literal[t] = right.astype(_N), ~right
        length = LENGTH.take(now)
        at = model.cum_row + length
        rest = 65536 - model.hit_size
        a = np.where(right, 0, model.hit_size + (model.cum.take(at) * rest >> 8))
        b = np.where(right, model.hit_size, model.hit_size + (model.cum.take(at + 1) * rest >> 8))
        unit = size >> _U(16)
        low += a.astype(_U) * unit
        size = (b - a).astype(_U) * unit
        todo = np.flatnonzero(size < _U(1 << 32))
        while len(todo):
            l, s = low[todo], size[todo]
            straddles = ((l ^ (l + s - _U(1))) >> _TOP) != 0
            s = np.where(straddles, _U(1 << 32) - (l & _LOW32), s)
            words[used[todo]] = (l >> _TOP).astype(np.uint16)
            used[todo] += 1
            low[todo], size[todo] = (l << _U(16)) & _MASK48, s << _U(16)
            todo = todo[s << _U(16) < _U(1 << 32)]
        model.learn(now, hit, length)
    for shift in (32, 16, 0):
        words[used] = (low >> _U(shift)).astype(np.uint16)
        used += 1
    out = []
    bits = np.where(literal.T, np.maximum(LENGTH[grid] - 1, 0), 0)
    for k in range(lanes):
        mine = whole[k * block : k * block + steps]
        wide = mine[mine >= WIDE].astype("<u4")
        raw = _raw(grid[k], bits[k])
        coded = words[first[k] : used[k]]
        out.append(np.array([len(mine), zlib.crc32(mine.astype("<u4").tobytes()), len(coded), len(raw), len(wide)], "<u4").tobytes() + coded.astype("<u2").tobytes() + raw.astype("<u2").tobytes() + wide.tobytes())
    return out


def _raw(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The lower ``bits`` of each id, one after the other, in 16-bit words (the first bit is the highest)."""
    ends = np.cumsum(bits)
    total = int(ends[-1]) // 16 + 2
    value = ids & ((1 << bits) - 1)
    place, at = ends - bits, (ends - bits) >> 4
    wide = value << (32 - (place & 15) - bits)
    return (np.bincount(at, wide >> 16, total) + np.bincount(at + 1, wide & 0xFFFF, total)).astype(np.uint16)


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where a block's checksum doesn't fit."""
    if not blocks:
        return []
    heads = np.array([np.frombuffer(x, "<u4", 5) for x in blocks], _I)
    lanes, steps = len(blocks), int(heads[:, 0].max())
    # blocks of a sequence are all of one length but the last, which was padded to it
    wide = int(heads[:, 2].max()) + 4, int(heads[:, 3].max()) + 4
    words, raw = np.zeros((lanes, wide[0]), np.uint16), np.zeros((lanes, wide[1]), np.uint16)
    for k, x in enumerate(blocks):
        body = np.frombuffer(x, "<u2", int(heads[k, 2] + heads[k, 3]), 20)
        words[k, : heads[k, 2]], raw[k, : heads[k, 3]] = body[: heads[k, 2]], body[heads[k, 2] :]
    words, raw = words.ravel(), raw.ravel()
    first, raw_first = np.arange(lanes, dtype=_I) * wide[0], np.arange(lanes, dtype=_I) * wide[1]
    last_word = first + wide[0] - 1
    used, bit = first + 3, np.zeros(lanes, _I)
    code = sum(words[first + i].astype(_U) << _U(32 - 16 * i) for i in range(3))
    low, size = np.zeros(lanes, _U), np.full(lanes, 1 << 48, _U)
    model, out = _Model(lanes), np.empty((steps, lanes), _E)
    class_of = np.repeat(np.arange(CLASSES), 256)  # replaced at the first renewal
    class_row = np.arange(lanes) * 256
    for t in range(steps):
        renewed = model.step % RENEW == 0
        model.predict()
        if renewed:
            class_of = np.repeat(np.tile(np.arange(CLASSES), lanes), model.share.ravel())
        unit = size >> _U(16)
        v = np.minimum((code - low).astype(_F) / unit.astype(_F), 65535).astype(_I)  # both below 2**53, so rounded down as integers would be
        right = v < model.hit_size
        hit = right.astype(_N)
        rest = 65536 - model.hit_size
        # the class whose interval holds v: the 8-bit share below it, or the next, as intervals are rounded down
        part = np.clip(((v - model.hit_size) << 8) / rest, 0, 255).astype(_I)
        length = class_of.take(class_row + part)
        at = model.cum_row + length
        at += (model.hit_size + (model.cum.take(at + 1) * rest >> 8) <= v) & ~right
        length = at - model.cum_row
        bits = np.where(right, 0, np.maximum(length - 1, 0))
        word = raw_first + (bit >> 4)
        window = raw.take(word).astype(_I) << 16 | raw.take(word + 1)
        lower = (window >> (32 - (bit & 15) - bits)) & ((1 << bits) - 1)
        bit += bits
        now = np.where(right, model.guess, np.where(length > 0, lower | (1 << bits), 0)).astype(_E)
        length = LENGTH.take(now)
        out[t] = now
        a = np.where(right, 0, model.hit_size + (model.cum.take(at) * rest >> 8))
        b = np.where(right, model.hit_size, model.hit_size + (model.cum.take(at + 1) * rest >> 8))
        low += a.astype(_U) * unit
        size = (b - a).astype(_U) * unit
        todo = np.flatnonzero(size < _U(1 << 32))
        while len(todo):
            l, s = low[todo], size[todo]
            straddles = ((l ^ (l + s - _U(1))) >> _TOP) != 0
            s = np.where(straddles, _U(1 << 32) - (l & _LOW32), s)
            code[todo] = (code[todo] << _U(16)) & _MASK48 | words[np.minimum(used[todo], last_word[todo])]
            used[todo] += 1
            low[todo], size[todo] = (l << _U(16)) & _MASK48, s << _U(16)
            todo = todo[s << _U(16) < _U(1 << 32)]
        model.learn(now, hit, length)
    out = np.ascontiguousarray(out.T)
    ids = [out[k, : heads[k, 0]] for k in range(lanes)]
    for k in np.flatnonzero(heads[:, 4]):
        ids[k][ids[k] == WIDE] = np.frombuffer(blocks[k], "<u4", int(heads[k, 4]), 20 + 2 * int(heads[k, 2] + heads[k, 3]))
    for x, h in zip(ids, heads, strict=True):
        if zlib.crc32(x.astype("<u4").tobytes()) != h[1]:
            raise ValueError("a block's checksum doesn't fit its ids")
    return ids
