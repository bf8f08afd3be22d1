"""Language-model scoring by a weighted backoff automaton.

States are the histories of one and two tokens seen in training, and the empty one. An arc for each
n-gram seen carries its smoothed log-probability and leads to the state of the longest history
that then ends the text read; a failure arc, weighted by the history's backoff mass, leads to the
state of the history without its first token. Reading a text once from left to right, the scorer carries
the state, follows failure arcs until the next token has an arc, and sums log10 weights. Smoothing is
interpolated absolute discounting, the discounts coming from the counts of counts, over a
uniform share for unknown words, so a state's weights sum to one.

The automaton is never gathered in one place. Documents are read in chunks. A chunk's trigrams form a forest
(first token, then the second below it, then the third) whose nodes are n-grams, and each
chunk sends the parts of its forest to the buckets that own their roots, with its own training
counts, so asking and counting are one shuffle. Buckets add up and answer in the order of
the request; the chunk then holds exactly the part of the automaton that its texts can reach.
Buckets are ranges of the root's hash. Trees that a large share of tokens fall in are spread over as many
buckets as their share asks for, under roots moved by whole buckets, and what is told of
them is put together by the asker. Only parts that have something are sent, so messages are at most as
many as n-grams, whatever the numbers of chunks and buckets.

Tokens: words with A-Z lower-cased, then one end. Defined results: a null or empty text is the
end alone; a null id belongs to training; repeated rows are counted and scored each;
without training documents every token has probability 1 / (V + 1) = 1; extra columns are ignored.
Chunks are what a task reads of ``docs``, which must give the same rows in the same partitions when a
task is run again, as tables do; a chunk whose answers don't fit raises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import small_batches

#: Tokens are told apart by 48 bits of their hash; as the second or third of an n-gram by 32 of these.
_TOP = w.U64(0xFFFFFFFFFFFF0000)
END, PAD, ONE, TWO = w.mix(np.array([0xE0D, 0xBAD, 0x57A27, 0x57A28], w.U64)) & _TOP  # ONE and TWO stand before a text
#: Bytes of text in a chunk, and of text that a bucket counts for (with about twice as many bytes of requests).
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 4 << 20
#: A history that begins more than this share of all n-grams may be spread over buckets.
HOT_SHARE = 1e-4
#: Tokens that one lane of the traversal reads.
LANE = 256
_HALF = w.U64(32)
#: Over buckets: tokens, distinct n-grams, and n-grams seen once and twice, for each length; in training.
SUMS = [f"{what}{k}" for k in (1, 2, 3) for what in ("n", "distinct", "once", "twice")]


def in_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for i in ids], bool)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of TWO ONE word ... word END PAD for every text, and where each text's begin (one more entry: the end)."""
    data, starts = w.text_bytes(texts)
    runs = w.Runs(data, starts)
    docs = len(starts) - 1
    begin = np.concatenate(([0], np.cumsum(w.per_doc(runs.doc, docs) + 4)))
    out = np.empty(int(begin[-1]), w.U64)
    out[np.arange(len(runs.doc)) + 4 * runs.doc + 2] = runs.hash & _TOP
    out[begin[:-1]], out[begin[:-1] + 1], out[begin[1:] - 2], out[begin[1:] - 1] = TWO, ONE, END, PAD
    return out, begin


def _trigrams(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where trigrams start: everywhere but at each text's last two tokens."""
    inside = np.ones(len(tokens), bool)
    inside[begin[1:] - 1] = inside[begin[1:] - 2] = False
    return np.flatnonzero(inside)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return w.mix(a * w.BASE + b)


def _numbered(x: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The number of each value among the distinct ones in order, and where each distinct one is first found; ``bits`` are enough for the values.

    Values are sorted with their places in the low bits, as that takes a fraction of an indirect sort; where that leaves too
    few bits to tell values apart, they are sorted indirectly.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = w.U64(max(1, (n - 1).bit_length()))
    shift = w.U64(max(0, bits + int(low) - 64))
    packed = np.sort((x >> shift) << low | np.arange(n, dtype=w.U64))
    order = (packed & ((w.U64(1) << low) - w.U64(1))).astype(np.int64)
    ordered = x[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])
    if shift and (fresh[1:] & (packed[1:] >> low == packed[:-1] >> low)).any():
        _, first, number = np.unique(x, return_index=True, return_inverse=True)
        return number, first
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(fresh) - 1
    return number, order[fresh]


class Chunk:
    """The forest of a chunk's texts, with its training counts and what is spread over buckets.

    Roots, nodes (by root) and leaves (by node) are in order of their hashes; ``leaf`` is each trigram's.
    """

    def __init__(self, ids: list, texts: pa.Array, buckets: int, hot: list[dict[int, int]]):
        self.train = in_training(ids)
        tokens, begin = _tokens(texts)
        self.sizes = np.diff(begin) - 2  # trigrams of each text; one less are its tokens
        number, first_at = _numbered(tokens)
        words = tokens[first_at]
        at = _trigrams(tokens, begin)
        one, two, three = number[at], number[at + 1], number[at + 2]
        self.step = _step(buckets)
        #: Roots and nodes that are one spread history, its first part first.
        self.groups: list[list[np.ndarray]] = [[], []]
        root, roots = one, words
        more_roots = more_nodes = np.empty(0, w.U64)
        node_word, node_parts = np.empty(0, np.int64), np.empty(0, np.int64)
        parts = np.array([hot[0].get(h, 1) for h in words.tolist()], w.U64) if hot[0] else np.empty(0, w.U64)
        many = np.flatnonzero(parts[one] > 1) if len(parts) else np.empty(0, np.int64)
        if len(many):
            alias = words[one]
            alias[many] += w.mix(words[two[many]] + w.U64(3)) % parts[one[many]] * self.step
            pairs = np.array(sorted(h for h, k in hot[1].items() if k > 1), w.U64)
            if len(pairs):
                pair = _pair(words[one[many]], words[two[many]])
                slot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                mine = pairs[slot] == pair
                spread, slot = many[mine], slot[mine]
                pair_parts = np.array([hot[1][h] for h in pairs.tolist()], np.int64)
                _, seen = np.unique(slot, return_index=True)
                node_parts, node_word = pair_parts[slot[seen]], two[spread[seen]]
                more_nodes = _parts(alias[spread[seen]], node_parts, self.step)
                alias[spread] += w.mix(words[three[spread]] + w.U64(5)) % pair_parts[slot].astype(w.U64) * self.step
            spread_words = np.unique(one[many])
            more_roots = _parts(words[spread_words], parts[spread_words].astype(np.int64), self.step)
            root, found = _numbered(np.concatenate([alias, more_nodes, more_roots]))
            roots = np.concatenate([alias, more_nodes, more_roots])[found]
            self.groups[0] = np.split(root[len(alias) + len(more_nodes) :], np.cumsum(parts[spread_words].astype(np.int64))[:-1])
        vocabulary = len(words)
        second = np.concatenate([two, np.repeat(node_word, node_parts)])
        bits = max(1, (vocabulary * max(1, len(roots))).bit_length())
        node, found = _numbered((root[: len(second)] * vocabulary + second).astype(w.U64), bits)
        if len(node_parts):
            self.groups[1] = np.split(node[len(two) :], np.cumsum(node_parts)[:-1])
        self.node_root, self.second = root[found], words[second[found]] >> _HALF
        bits = max(1, (vocabulary * max(1, len(found))).bit_length())
        self.leaf, found = _numbered((node[: len(three)] * vocabulary + three).astype(w.U64), bits)
        self.leaf_node, self.third = node[found], words[three[found]] >> _HALF
        # a word that no trigram begins with is no root
        used = np.zeros(len(roots), bool)
        used[root] = True
        place = np.cumsum(used) - 1
        self.roots, self.node_root = roots[used], place[self.node_root]
        self.groups[0] = [place[g] for g in self.groups[0]]
        self.leaf_count = np.bincount(self.leaf, np.repeat(self.train, self.sizes), len(self.third)).astype(np.int64)
        self.node_count = np.bincount(self.leaf_node, self.leaf_count, len(self.second)).astype(np.int64)
        self._gathered(self.node_count, self.groups[1])
        self.root_count = np.bincount(self.node_root, self.node_count, len(self.roots)).astype(np.int64)
        self._gathered(self.root_count, self.groups[0])

    @staticmethod
    def _gathered(counts: np.ndarray, groups: list[np.ndarray]) -> None:
        """Counts of what is spread stand at its first part."""
        for g in groups:
            total = counts[g].sum()
            counts[g] = 0
            counts[g[0]] = total

    def below(self) -> tuple[np.ndarray, np.ndarray]:
        """How many nodes each root has, and how many leaves each node."""
        return np.bincount(self.node_root, minlength=len(self.roots)), np.bincount(self.leaf_node, minlength=len(self.second))

    def requests(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        bucket = _bucket(self.roots, self.step, buckets)
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
        roots = np.append(heads, len(self.roots))
        nodes = np.searchsorted(self.node_root, roots)
        leaves = np.searchsorted(self.leaf_node, nodes)
        below, under = self.below()
        for i, b in enumerate(bucket[heads].tolist()):
            r, n, l = slice(roots[i], roots[i + 1]), slice(nodes[i], nodes[i + 1]), slice(leaves[i], leaves[i + 1])
            yield b, _pack((self.roots[r], 8), (self.root_count[r], 5), (below[r], 4), (self.second[n], 4), (self.node_count[n], 5), (under[n], 4), (self.third[l], 4), (self.leaf_count[l], 5))

    def outline(self) -> bytes:
        """What is needed to read answers: the forest's shape, each trigram's leaf and what is spread."""
        spread = [x for groups in self.groups for x in (np.array([len(g) for g in groups], np.int64), np.concatenate([np.empty(0, np.int64), *groups]))]
        return _pack(*((x, 4) for x in self.below()), (self.leaf, 4), (self.sizes, 8), (self.train, 1), *((x, 4) for x in spread))


def _parts(home: np.ndarray, parts: np.ndarray, step: w.U64) -> np.ndarray:
    """The roots of all parts of each spread history, its own first."""
    place = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(home, parts) + place.astype(w.U64) * step


def _step(buckets: int) -> w.U64:
    """How far the buckets' ranges of hashes are apart."""
    return w.U64(((1 << 64) - 1) // buckets) & _TOP


def _bucket(root: np.ndarray, step: w.U64, buckets: int) -> np.ndarray:
    return np.minimum(root // step, w.U64(buckets - 1)).astype(np.int64)


def _pack(*columns: tuple[np.ndarray, int]) -> bytes:
    """Columns of numbers of so many bytes, plane by plane (high planes of small numbers compress to nothing)."""
    planes = [np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes() for x, width in columns]
    raw = b"".join([np.array([len(columns), *(v for x, width in columns for v in (len(x), width))], "<u4").tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    columns = int(np.frombuffer(raw, "<u4", 1)[0])
    heads, at, out = np.frombuffer(raw, "<u4", 2 * columns, 4).reshape(-1, 2).tolist(), 4 + 8 * columns, []
    for many, width in heads:
        full = np.zeros((many, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, many * width, at).reshape(width, many).T
        out.append(full.view("<u8").ravel())
        at += many * width
    return out


class Count:
    """One bucket: adds up all chunks' counts."""

    def __init__(self, requests: list[bytes]):
        parts = [_unpack(x) for x in requests]
        root, root_count, below, second, node_count, under, third, leaf_count = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.lengths = [(len(p[0]), len(p[3]), len(p[6])) for p in parts]
        root_of, found = _numbered(root)
        self.roots = root[found]
        in_root = np.repeat(root_of, below.astype(np.int64))
        node_of, found = _numbered(w.mix(in_root.astype(w.U64) << _HALF | second))
        self.node_root = in_root[found]
        in_node = np.repeat(node_of, under.astype(np.int64))
        leaf_of, found = _numbered(w.mix(in_node.astype(w.U64) << _HALF | third))
        self.leaf_node, self.third = in_node[found], third[found]
        self.of = (root_of, node_of, leaf_of)
        sizes = (len(self.roots), len(self.node_root), len(self.leaf_node))
        self.counts = [np.bincount(o, c, n).astype(np.int64) for o, c, n in zip(self.of, (root_count, node_count, leaf_count), sizes, strict=True)]

    def answers(self) -> Iterator[bytes]:
        follow = [np.bincount(self.node_root, self.counts[1] > 0, len(self.roots)), np.bincount(self.leaf_node, self.counts[2] > 0, len(self.node_root))]
        columns = [self.counts[0][self.of[0]], follow[0][self.of[0]], self.counts[1][self.of[1]], follow[1][self.of[1]], self.counts[2][self.of[2]]]
        at = np.zeros(3, np.int64)
        for lengths in self.lengths:
            r, n, l = (slice(a, a + k) for a, k in zip(at, lengths, strict=True))
            yield _pack((columns[0][r], 6), (columns[1][r], 5), (columns[2][n], 5), (columns[3][n], 5), (columns[4][l], 5))
            at += lengths

    def sums(self, starts: np.ndarray) -> list[int]:
        """``SUMS`` of this bucket, without what stands for places before a text or after it; ``starts``: roots that stand for the former."""
        pad = PAD >> _HALF
        words = ~np.isin(self.roots, starts[0])
        nodes = ~np.isin(self.roots, starts[1])[self.node_root]
        out = []
        for counts in (self.counts[0][words], self.counts[1][nodes], self.counts[2][self.third != pad]):
            out += [int(counts.sum()), int((counts > 0).sum()), int((counts == 1).sum()), int((counts == 2).sum())]
        return out


def _hot_histories(texts: DataFrame) -> list[dict[int, float]]:
    """Histories of one and of two tokens that begin more than HOT_SHARE of all trigrams, and their share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text", 4 * w.CHUNK):
                tokens, begin = _tokens(part.column("text"))
                at = _trigrams(tokens, begin)
                rows, many = [(np.zeros(1, np.int64), np.array([len(at)]), np.zeros(1, np.int64))], len(at)
                for k in (1, 2):
                    history = tokens[at] if k == 1 else _pair(tokens[at], tokens[at + 1])
                    seen, inverse, counts = np.unique(history, return_inverse=True, return_counts=True)
                    often = counts > many * HOT_SHARE * 10
                    rows.append((seen[often].view(np.int64), counts[often], np.full(int(often.sum()), k)))
                    at = at[often[inverse]]  # no longer history is more frequent than its beginning
                history, n, level = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(history), pa.array(n)], ["level", "history", "n"])

    rows = texts.select("text").mapInArrow(run, "level long, history long, n long").groupBy("level", "history").agg(F.sum("n").alias("n"))
    rows = rows.persist()
    hot: list[dict[int, float]] = [{}, {}]
    total = rows.where("level = 0").first()
    if total is not None:
        often = rows.where((F.col("n") > total["n"] * HOT_SHARE) & (F.col("level") > 0)).orderBy(F.desc("n")).limit(2 * int(1 / HOT_SHARE)).collect()
        for r in often:
            hot[r["level"] - 1][int(np.array([r["history"]]).view(w.U64)[0])] = r["n"] / total["n"]
    rows.unpersist()
    return hot


def _chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.Table]:
    """A task's rows in chunks of about ``chunk_bytes`` of text."""
    held, size = [], 0
    for batch in batches:
        for part in w.slices(batch, "text", chunk_bytes):
            more = part.column("text").nbytes
            if held and size + more > chunk_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield pa.Table.from_batches(held)


class Automaton:
    """What a chunk's texts can reach of the automaton: weights of arcs and failure arcs."""

    def __init__(self, node_root: np.ndarray, leaf_node: np.ndarray, groups: list[list[np.ndarray]], told: list[np.ndarray], sums: dict[str, int], leaf: np.ndarray, sizes: np.ndarray):
        c1, t1, c2, t2, c3 = told
        for counts, group in ((c1, groups[0]), (t1, groups[0]), (c2, groups[1]), (t2, groups[1])):
            for g in group:
                counts[g] = counts[g].sum()
        home_root, home_node = np.arange(len(c1)), np.arange(len(c2))
        for home, group in ((home_root, groups[0]), (home_node, groups[1])):
            for g in group:
                home[g] = g[0]
        #: The states that each trigram starts from: of its first token, and of its first two.
        leaf_state = home_node[leaf_node]
        node_state = home_root[node_root]
        begin = np.concatenate(([0], np.cumsum(sizes)))
        texts_read = int(c1[node_state[leaf_state[leaf[0]]]]) if len(leaf) else 0  # every text starts with TWO
        ends = sums["n1"] + texts_read
        self.known_tokens, distinct = ends, sums["distinct1"] + (texts_read > 0)
        cuts = []
        for k, (once, twice) in enumerate(((sums["once1"] + (texts_read == 1), sums["twice1"] + (texts_read == 2)), (sums["once2"], sums["twice2"]), (sums["once3"], sums["twice3"]))):
            cuts.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5)
        cut1, cut2, cut3 = cuts

        def root_weight(c):
            return (np.maximum(c - cut1, 0) + cut1 * distinct / (distinct + 1)) / ends if ends else np.ones(len(c))

        # where each text's tokens stand: the i-th token ends the i-th trigram, of which the last is no token's
        token = np.ones(len(leaf), bool)
        token[begin[1:] - 1] = False
        self.token = np.flatnonzero(token)
        state2 = leaf_state[leaf]  # of the two tokens before
        arc2 = np.append(state2[1:], 0)  # the node of the token and the one before it
        state1 = node_state[arc2]
        count1 = np.append(c1[node_state[state2]][2:], [0, 0])  # of the token itself, where a trigram starts with it
        count1[begin[1:] - 2] = texts_read  # the end
        has = (c1 > 0, c2 > 0)
        self.known = count1 > 0
        self.base = np.log10((count1 + 1) / (ends + distinct + 1))
        p1 = root_weight(count1)
        size1, size2 = np.maximum(c1, 1), np.maximum(c2, 1)
        # failure arcs: what a history leaves to the next shorter one
        self.fail1, self.fail2 = np.log10(np.where(has[0], np.maximum(cut2 * t1 / size1, 1e-300), 1)), np.log10(np.where(has[1], np.maximum(cut3 * t2 / size2, 1e-300), 1))
        p2 = (np.maximum(c2[arc2] - cut2, 0) + cut2 * t1[state1] * p1) / size1[state1]
        p2 = np.where(has[0][state1], p2, p1)
        p3 = (np.maximum(c3[leaf] - cut3, 0) + cut3 * t2[state2] * p2) / size2[state2]
        self.arcs = (np.log10(p1), (c2[arc2] > 0, np.log10(p2)), (c3[leaf] > 0, np.log10(np.where(has[1][state2], p3, p2))))
        self.states, self.has = (state1, state2), has
        # the state reached after a token: two tokens, one or none
        self.reached = np.where(has[1][arc2], 2, np.where(np.append(has[0][node_state[state2]][2:], [False, False]), 1, 0)).astype(np.int8)
        self.reached[begin[1:] - 2] = 0
        self.begin = begin

    def read(self) -> np.ndarray:
        """The log10 weight of every token, read from left to right.

        Texts are read in lanes of LANE tokens; a lane starts in the state that the token before it leads to.
        """
        at, out = self.token, np.zeros(len(self.token))
        if not len(at):
            return out
        first = np.isin(at, self.begin[:-1])
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        heads = np.flatnonzero(number % LANE == 0)
        lengths = np.diff(np.append(heads, len(at)))
        order = np.argsort(-lengths, kind="stable")
        heads, lengths = heads[order], lengths[order]
        state = np.where(number[heads] == 0, self._start(at[heads]), self.reached[np.maximum(at[heads] - 1, 0)])
        seen2, seen3 = self.arcs[1][0], self.arcs[2][0]
        for t in range(int(lengths[0])):
            lanes = int(np.searchsorted(-lengths, -t, "left"))  # those longer than t
            here = at[heads[:lanes] + t]
            state = state[:lanes]
            weight = np.zeros(lanes)
            fails = (state == 2) & ~seen3[here]
            weight[fails] += self.fail2[self.states[1][here[fails]]]
            state = np.where(fails, self.has[0][self.states[0][here]].astype(np.int8), state)
            fails = (state == 1) & ~seen2[here]
            weight[fails] += self.fail1[self.states[0][here[fails]]]
            state = np.where(fails, 0, state)
            weight += np.where(state == 2, self.arcs[2][1][here], np.where(state == 1, self.arcs[1][1][here], self.arcs[0][here]))
            out[heads[:lanes] + t] = weight
            state = self.reached[here]
        return out

    def _start(self, at: np.ndarray) -> np.ndarray:
        """The state before a text's first token: its two starts if training has any text, else none."""
        return np.where(self.has[1][self.states[1][at]], 2, np.where(self.has[0][self.states[0][at]], 1, 0)).astype(np.int8)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Documents whose crc32 of the id as text leaves 2 on division by 7 are held out of training.
    ``base_score`` is add-one unigram smoothing, ``score`` the automaton of trigrams.
    """
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    buckets = 1 + size // bucket_bytes
    hot = [{h: min(buckets, 1 + int(share * buckets)) for h, share in found.items() if share * buckets >= 2} for found in _hot_histories(texts)]
    step = _step(buckets)
    starts = [_parts(x, np.array([hot[0].get(int(h), 1) for h in x]), step) for x in (np.array([ONE, TWO], w.U64), np.array([TWO], w.U64))]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = np.array([TaskContext.get().partitionId()], w.U64)
        for k, table in enumerate(_chunks(batches, chunk_bytes)):
            chunk = Chunk(table["id"].to_pylist(), table["text"].combine_chunks(), buckets, hot)
            p = int(_pair(task, np.array([k], w.U64)).view(np.int64)[0])
            rows = [(-1 - (p & 0x3FFFFFFF), chunk.outline()), *chunk.requests(buckets)]
            ids = pa.ListArray.from_arrays(pa.array([0] + [len(table)] * len(rows), pa.int32()), table["id"].combine_chunks())
            del chunk
            w.trim()
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary()), ids], ["p", "bucket", "blob", "ids"])

    def count(key, table):
        if table["bucket"][0].as_py() < 0:  # outlines
            return table
        blobs = list(Count([x.as_py() for x in table["blob"]]).answers())
        w.trim()
        return table.set_column(2, "blob", pa.array(blobs, pa.binary()))

    def add_up(key, table):
        sums = [[x] for x in Count([x.as_py() for x in table["blob"]]).sums(starts)] if table["bucket"][0].as_py() >= 0 else [[] for _ in SUMS]
        return pa.table([pa.array(x, pa.int64()) for x in sums], SUMS)

    def read(key, table):
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        if (bucket < 0).sum() != 1 or len(order) < 2:
            raise ValueError("a chunk and its answers don't fit")
        blobs = [table["blob"][int(i)].as_py() for i in order]
        below, under, leaf, sizes, train, *spread = (x.astype(np.int64) for x in _unpack(blobs[0]))
        groups = [np.split(spread[k + 1], np.cumsum(spread[k])[:-1]) if len(spread[k]) else [] for k in (0, 2)]
        told = [np.concatenate(x).astype(np.int64) for x in zip(*map(_unpack, blobs[1:]), strict=True)]
        if [len(told[k]) for k in (0, 2)] != [len(below), len(under)]:
            raise ValueError("a chunk and its answers don't fit")
        sums = table["sums"][0].as_py()
        machine = Automaton(np.repeat(np.arange(len(below)), below), np.repeat(np.arange(len(under)), under), groups, told, sums, leaf, sizes)
        many = len(sizes)
        doc = np.repeat(np.arange(many), sizes - 1)
        add = lambda x: np.bincount(doc, x, many)
        at, weight = machine.token, machine.read()
        del told
        w.trim()
        return pa.table([
            table["ids"].combine_chunks()[int(order[0])].values, pa.array(train == 0), pa.array(sizes - 1), pa.array(add(machine.known[at]).astype(np.int64)),
            pa.array(np.full(many, machine.known_tokens, np.int64)), pa.array(add(machine.base[at])), pa.array(add(weight)),
        ], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    message = f"p long, bucket int, blob binary, ids array<{kind}>"
    asked = texts.mapInArrow(ask, message)
    sums = asked.groupBy("bucket").applyInArrow(add_up, ", ".join(f"{c} long" for c in SUMS)).agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS)).alias("sums"))
    answers = asked.groupBy("bucket").applyInArrow(count, message).withColumn("sums", sums.scalar())
    out = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("p").applyInArrow(read, out)
