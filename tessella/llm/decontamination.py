"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One pass over the corpus looks for the n-grams of all test items in each document and aligns the
words around every hit with the whole item, so copies with words replaced, dropped, added or
moved a little still score. Every n-gram is a seed and one hit is enough. Where common n-grams
hit, a window is aligned only if it has enough of the item's words to reach the threshold at
all; this rules out nothing that could. A copy that keeps no n words in a row has no seed.

Words are runs of letters and digits in lower case; punctuation does not count.
Test items are taken in blocks of about ``block_bytes`` of text (all of them against all
rows, one corpus scan a block), so what each task holds is bounded whatever the benchmark's size; with more than one
block, what they find is joined to the rows by their texts' hash.

Defined results: null or empty documents and items match nothing, nor do items of fewer than
``n`` words; repeated items report each item id once; repeated documents are matched each;
an empty benchmark matches nothing; columns of any other name pass through in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import words as w
from .common import beside_text, cut, small_batches, whole_row

MATCH = StructType([StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("start", LongType()), StructField("end", LongType())])
_SHIFT = np.int64(1 << 24)
#: Hits expanded at once, and what keeps places before a text's first word from being negative.
HITS, _BEFORE = 1 << 18, 1 << 31


def _word_runs(texts: pa.Array) -> tuple[w.Runs, int]:
    """The words of all texts, and how many texts there are."""
    data, starts = w.text_bytes(pc.utf8_lower(texts))
    return w.Runs(data, starts, w.BREAK), len(starts) - 1


class Items:
    """A block of test items: word hashes, and each distinct n-gram with the places that have it."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int):
        runs, _ = _word_runs(texts)
        at = np.searchsorted(runs.doc, np.arange(len(ids) + 1))
        self.ids, self.n = ids, n
        self.words = [runs.hash[at[i] : at[i + 1]] for i in range(len(ids))]
        keys, where = w.windows(runs.hash, runs.doc, n)
        order = np.argsort(keys, kind="stable")
        self.key, self.item = keys[order], runs.doc[where[order]]
        self.place = where[order] - at[self.item]


def align(item: np.ndarray, rows: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item against many equally long rows of words at once.

    Returns best score, and first and end column of the best local alignment. A cell holds its
    score and, in the low bits, the column where its alignment began, so both move together;
    gaps along a row are a running maximum.
    """
    many, wide = rows.shape
    step = np.arange(wide, dtype=np.int64) * (gap * _SHIFT)
    fresh = np.arange(wide + 1, dtype=np.int64)
    above = np.broadcast_to(fresh, (many, wide + 1)).copy()
    best, end = np.zeros(many, np.int64), np.zeros(many, np.int64)
    for word in item:
        cell = above[:, :-1] + np.where(rows == word, match * _SHIFT, -mismatch * _SHIFT)
        np.maximum(cell, above[:, 1:] - gap * _SHIFT, out=cell)
        np.maximum(cell, fresh[1:], out=cell)
        cell += step
        np.maximum.accumulate(cell, axis=1, out=cell)
        cell -= step
        above[:, 1:] = cell
        at = cell.argmax(axis=1)
        top = cell[np.arange(many), at]
        better = top // _SHIFT > best // _SHIFT
        best[better], end[better] = top[better], at[better] + 1
    return best // _SHIFT, best % _SHIFT, end


def _common(item: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many words each row has in common with the item, each as often as both have it: no alignment matches more."""
    known, times = np.unique(item, return_counts=True)
    slot = np.minimum(np.searchsorted(known, rows), len(known) - 1)
    row, _ = hit = np.nonzero(known[slot] == rows)
    counts = np.bincount(row * len(known) + slot[hit], minlength=len(rows) * len(known))
    return np.minimum(counts.reshape(len(rows), len(known)), times).sum(axis=1)


def _placed(doc_of: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, items: Items) -> np.ndarray:
    """Where hits would put an item: sorted distinct (document, item, first word), packed. A hit is a window at word ``at`` that equals
    the seeds from ``left`` to ``right``; many hits of a repetitive text lie on one diagonal, so they are expanded in bounded
    batches and what each batch adds is one entry a diagonal."""
    hit = np.flatnonzero(right > left)
    times = (right - left)[hit]
    found, held, begin = [], 0, 0
    ends = np.cumsum(times)
    while begin < len(hit):
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + HITS, "right")))
        some, n = hit[begin:to], times[begin:to]
        entry = np.repeat(left[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        word = np.repeat(at[some], n)
        found.append(np.unique((doc_of[word] * len(items.ids) + items.item[entry]) << 32 | word - items.place[entry] + _BEFORE))
        held, begin = held + len(found[-1]), to
        if held > 8 * HITS:
            found = [np.unique(np.concatenate(found))]
            held = len(found[0])
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _matches(items: Items, texts: pa.Array, least_score: float) -> list[list[tuple]]:
    runs, docs = _word_runs(texts)
    out: list[dict] = [{} for _ in range(docs)]
    keys, at = w.windows(runs.hash, runs.doc, items.n)
    left, right = np.searchsorted(items.key, keys, "left"), np.searchsorted(items.key, keys, "right")
    key = _placed(runs.doc, at, left, right, items)
    if not len(key):
        return [[] for _ in out]
    doc, item = np.divmod(key >> 32, len(items.ids))
    begin = (key & 0xFFFFFFFF) - _BEFORE
    size = np.array([len(x) for x in items.words])[item]
    first_word = np.searchsorted(runs.doc, np.arange(len(out) + 1))
    # hits that would put the item at about the same place share a window
    near = np.maximum(3, size // 4)
    apart = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(begin) > near[1:])
    head = np.flatnonzero(np.concatenate(([True], apart)))
    last = np.append(head[1:], len(doc)) - 1
    padded = np.append(runs.hash, w.U64(0))
    for i in np.unique(item[head]):
        mine, ends = head[item[head] == i], last[item[head] == i]
        words = items.words[i]
        # no alignment that reaches the threshold has more gaps than this
        margin = max(4, int(2 * len(words) * (1 - least_score)))
        lo, hi = begin[mine] - margin, begin[ends] + len(words) + margin
        wide = hi - lo
        for kind in np.unique(wide):  # windows of one length are aligned together
            for part in np.array_split(np.flatnonzero(wide == kind), max(1, int((wide == kind).sum() * kind // 200_000))):
                if not len(part):
                    continue
                d = doc[mine[part]]
                cols = lo[part][:, None] + np.arange(kind)
                inside = (cols >= first_word[d][:, None]) & (cols < first_word[d + 1][:, None])
                rows = np.where(inside, padded[np.clip(cols, 0, len(runs.hash))], w.U64(0))
                able = _common(words, rows) >= least_score * len(words)
                if not able.any():
                    continue
                cols, rows, d = cols[able], rows[able], d[able]
                score, start, end = align(words, rows)
                for k in np.flatnonzero(score >= least_score * 2 * len(words)):
                    a = min(int(cols[k, start[k]]), len(runs.hash) - 1) - int(first_word[d[k]])
                    b = int(cols[k, end[k] - 1]) + 1 - int(first_word[d[k]])
                    found = (float(score[k]) / (2 * len(words)), -a, -b)
                    name = items.ids[i]
                    out[d[k]][name] = max(found, out[d[k]].get(name, found))
    return [[(name, s, -a, -b) for name, (s, a, b) in sorted(x.items())] for x in out]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list[int], pa.Array]]:
    texts = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for b in range(blocks if total else 0):
        got = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).distinct().orderBy("id", "text").toArrow()
        yield got["id"].to_pylist(), got["text"].combine_chunks()


def contaminated(docs: DataFrame, items: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", n: int = 3, threshold: float = 0.5, block_bytes: int = 4 << 20) -> DataFrame:
    """Columns ``keep`` of docs (default: all) in the struct ``row``, and ``matches``.

    ``matches`` has (item_id, score, start, end) for every item whose alignment reaches
    ``threshold`` of the score of a whole exact copy; start and end count the document's words.
    """
    keep = list(docs.columns if keep is None else keep)
    text = F.col(text_col).cast("string").alias("text")
    blocks = (b for b in (Items(ids, texts, n) for ids, texts in _blocks(items, item_id_col, item_text_col, block_bytes)) if len(b.key))
    none = F.array().cast(ArrayType(MATCH)).alias("matches")
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), none)
    if more is None:
        head = small_batches(docs).select(beside_text(docs, keep, text_col), text)
        found = _searched(head, block, threshold, ["row"] + ["text"] * (text_col in keep))
        return found.select(whole_row(docs, keep, text_col), "matches")
    # a scan a block, so that a task and the driver hold one or two; what each finds is written, and put together by the text's hash
    keyed = small_batches(docs).select(*_text_key(text), text)
    hits = None
    while block is not None:
        found = cut(_searched(keyed, block, threshold, ["k1", "k2"]).where(F.size("matches") > 0))
        hits = found if hits is None else hits.union(found)
        block, more = more, next(blocks, None)
    each = hits.select("k1", "k2", F.explode("matches").alias("m")).distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list("m")).alias("matches"))
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    joined = docs.select(row, *_text_key(text)).join(cut(each), ["k1", "k2"], "left")
    return joined.select("row", F.coalesce("matches", none).alias("matches"))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _searched(docs: DataFrame, block: Items, threshold: float, out: Sequence[str]) -> DataFrame:
    """Columns ``out`` of docs and the ``matches`` of a block of items."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                found = [[dict(zip(MATCH.names, x, strict=True)) for x in f] for f in _matches(block, part.column("text"), threshold)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in out), pa.array(found, kind)], [*out, "matches"])

    return docs.mapInArrow(run, StructType([*(docs.schema[c] for c in out), StructField("matches", ArrayType(MATCH))]))
