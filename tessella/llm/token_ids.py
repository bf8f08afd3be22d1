"""Token ids of whole texts, with a public tokenizer file.

A text's ids are those of its words in turn (words here: runs between ASCII white space; what other
white space a word holds is the tokenizer's affair), for tokenizers that split at white space before anything
else; the encoder reads from the file whether its tokenizer does, and encodes whole texts if not. Each distinct
word is encoded once in a task, which is what makes long texts cheap; the words remembered are bounded in number and bytes.
Word-end tokenizers that lower-case get words with A-Z lower-cased already, unless a text may spell a special token.
"""

from __future__ import annotations

import json
import os
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import words as w

#: Distinct words, and ids of words, that a worker remembers from task to task (about 40 bytes a word in all).
REMEMBERED = 2_000_000
#: Bytes of text that are encoded at once.
SLICE = 4 << 20
#: What may follow a word's letters and is a token run of its own (an apostrophe may join them, a "<" begin a special token).
TAIL = "".join(c for c in string.punctuation if c not in "'<")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(file: str, remembered: int = REMEMBERED) -> Encoder:
    """This worker's encoder for a path, or for the name of a public tokenizer."""
    return Encoder(file, remembered)


class Encoder:
    """Encodes batches of texts, remembering words."""

    def __init__(self, file: str, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = _tokenizer(file if "/" in file else vocabulary_path(file)), remembered
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and "Lowercase" in _kinds(json.loads(normalizer.__getstate__()))
        self.by_word = _splits_at_space(self.tokenizer.pre_tokenizer)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix and self.lowers:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.places = w.Places()
        self.ids, self.used = np.empty(1 << 16, np.uint16), 1  # the first place is for the end
        self.begin, self.many = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        got = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        lists = [x.ids for x in got]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes

    def _plain_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_ids`` of words that are lower-case letters only, in long lines: a word ends where a token is a word end."""
        flat, _ = self._ids([" ".join(words[k : k + 256]) for k in range(0, len(words), 256)])
        stops = np.flatnonzero(self.ends[flat])
        return (flat, np.diff(stops, prepend=-1)) if len(stops) == len(words) else self._ids(words)

    def _store(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Remembers the ids of distinct words that are not there."""
        if len(flat) and flat.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        n, total = self.places.size, self.used + len(flat)
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while len(self.begin) < n + len(hashes):
            self.begin, self.many = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.many))
        self.ids[self.used : total] = flat
        self.begin[n : n + len(hashes)] = self.used + np.cumsum(sizes) - sizes
        self.many[n : n + len(hashes)] = sizes
        self.used = total
        self.places.add(hashes)

    def _learn(self, fresh: pa.Array, hashes: np.ndarray) -> None:
        """Remembers distinct words that are not there, and their letters where something follows those."""
        if self.ends is None:
            self._store(hashes, *self._ids(fresh.to_pylist()))
            return
        # letters, then what follows them, if anything
        cores = pc.utf8_rtrim(fresh, TAIL)
        plain = np.asarray(pc.and_(pc.utf8_is_alpha(cores), pc.utf8_is_lower(cores)))
        other = fresh.filter(pa.array(~plain))
        if len(other):
            self._store(hashes[~plain], *self._ids(other.to_pylist()))
        fresh, cores, hashes = fresh.filter(pa.array(plain)), cores.filter(pa.array(plain)), hashes[plain]
        heads = cores.dictionary_encode()
        head_hashes = _hashes(heads.dictionary)
        unknown = np.flatnonzero(self.places.find(head_hashes) < 0)
        if len(unknown):
            self._store(head_hashes[unknown], *self._plain_ids(heads.dictionary.take(pa.array(unknown)).to_pylist()))
        more = np.flatnonzero(self.places.find(hashes) < 0)
        if len(more):
            first = self.places.find(head_hashes)[np.asarray(heads.indices)[more]]
            tails = _rest(fresh.take(pa.array(more)), cores.take(pa.array(more))).dictionary_encode()
            ids, sizes = self._ids(tails.dictionary.to_pylist())
            second = np.asarray(tails.indices)
            begin = np.stack([self.begin[first], (np.cumsum(sizes) - sizes)[second]], axis=1).ravel()
            many = np.stack([self.many[first], sizes[second]], axis=1).ravel()
            at = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            head = np.repeat(np.tile([True, False], len(more)), many)
            flat = np.empty(len(at), np.int64)
            flat[head], flat[~head] = self.ids[at[head]], ids[at[~head]]
            self._store(hashes[more], flat, many.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end``, and where each text begins (one more entry: the end)."""
        if not self.by_word:
            flat, sizes = self._ids(pc.fill_null(texts, "").to_pylist())
            stops = np.cumsum(sizes + 1)
            out = np.full(int(stops[-1]) if len(stops) else 0, end, np.int64)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = flat
            return out, np.concatenate(([0], stops))
        data, starts = w.text_bytes(texts)
        if self.lowers:
            lower = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
            marked = np.searchsorted(starts, np.flatnonzero(data == ord("<")), "right") - 1
            if len(marked):
                lower = lower.copy()
                for i in np.unique(marked):
                    lower[starts[i] : starts[i + 1]] = data[starts[i] : starts[i + 1]]
            data = lower
        inside = np.frombuffer(data.tobytes().translate(_INSIDE), bool)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # texts end in a newline
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        begins, sizes = edges[::2], edges[1::2] - edges[::2]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        flat = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(None, _SPACES)))
        words = flat.dictionary_encode()
        per_text = np.diff(np.searchsorted(begins, starts))
        if self.places.size > self.remembered or self.used > 8 * self.remembered:
            self._reset()
        hashes = _hashes(words.dictionary)
        number = self.places.find(hashes)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            self._learn(words.dictionary.take(pa.array(unknown)), hashes[unknown])
            number[unknown] = self.places.find(hashes[unknown])
        index = number[np.asarray(words.indices)]
        # the end is one more word after each text
        at = np.arange(len(words)) + np.repeat(np.arange(len(per_text)), per_text)
        many = np.ones(len(words) + len(per_text), np.int32)
        begin = np.zeros(len(many), np.int64)
        many[at], begin[at] = self.many[index], self.begin[index]
        if end > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        self.ids[0] = end
        stop = np.cumsum(many, dtype=np.int64)
        out = self.ids.take(np.repeat(begin - (stop - many), many) + np.arange(int(stop[-1]) if len(stop) else 0))
        ends = stop[np.cumsum(per_text + 1) - 1] if len(per_text) else stop
        return out, np.concatenate(([0], ends))


_LOWER = w.LOWER.tobytes()
_INSIDE = (~w.SPACE).astype(np.uint8).tobytes()
_SPACES = bytes(np.flatnonzero(w.SPACE).tolist())


def _kinds(told: dict | None) -> set[str]:
    """The types of a normalizer and of those that it is made of."""
    return {told["type"], *(k for part in told.get("normalizers", ()) for k in _kinds(part))} if told else set()


def _splits_at_space(pre_tokenizer) -> bool:
    """Whether no piece has white space in it, tried between all kinds of characters."""
    if pre_tokenizer is None:
        return False
    sides = "aZé1!日'<_"
    probe = "".join(a + s + b for s in "\x20\t\n\v\f\r" for a in sides for b in sides)
    return not any(set(probe[a:b]) & set("\x20\t\n\v\f\r") for _, (a, b) in pre_tokenizer.pre_tokenize_str(probe))


def _hashes(words: pa.LargeStringArray) -> np.ndarray:
    """Hashes of words (never 0)."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
    if not len(words):
        return np.empty(0, w.U64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    sizes, firsts = np.diff(ends), ends[:-1] - ends[0]
    place = np.arange(len(raw)) - np.repeat(firsts, sizes)
    power = np.full(int(sizes.max()), w.BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return np.maximum(w.mix(np.add.reduceat(w.BYTE.take(raw) * power.take(place), firsts) ^ sizes.astype(w.U64) * w.MIX1), w.U64(1))


def _rest(words: pa.LargeStringArray, heads: pa.LargeStringArray) -> pa.LargeStringArray:
    """What of each word comes after its head."""
    whole, head = (np.asarray(pc.binary_length(x)).astype(np.int64) for x in (words, heads))
    tail = whole - head
    offsets = np.concatenate(([0], np.cumsum(tail)))
    _, starts, raw = words.buffers()
    ends = np.frombuffer(starts, np.int64, len(words) + 1, 8 * words.offset)[1:]
    data = np.frombuffer(raw or b"", np.uint8)
    at = np.repeat(ends - tail - offsets[:-1], tail) + np.arange(int(offsets[-1]))
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(data[at]))
