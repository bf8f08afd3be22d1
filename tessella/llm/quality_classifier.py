"""Quality classifier with hierarchical empirical Bayes.

A logistic regression over word presence and text shape gives each document its own
evidence. Grouped aggregation sums that evidence for each path (say source and language)
and host (source); each level's prior strength is estimated from the spread between its
groups, so a site with few documents is drawn to the level above and a site with many
speaks for itself. A document's final odds are its own odds moved by its path's posterior
against the base rate the classifier was fitted with.

Only labelled rows up to ``max_train_rows`` (chosen by the hash of their id) and a vocabulary
bounded by ``max_vocabulary`` come to the driver; all counts and posteriors cover every row.

Defined results: null and empty texts are scored by the intercept and text shape alone; a null
host or path value is a group of its own; repeated rows are scored each; without labels of both
classes a head is neutral (0.5) and rejects nothing; other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import words as w
from .common import beside_text, cut, small_batches, whole_row

SHAPE = 11
#: Bytes of a word's beginning that are features of their own, and bits of a feature's hash.
PREFIXES, BITS = (5, 7), w.U64(44)
#: Word evidence is divided by this power of the number of known words. Quality is a matter of
#: the whole text; a few words make a text toxic, however long it is.
DAMPING = (0.5, 0.0)
#: Groups up to which the table of group posteriors is broadcast (about 100 bytes each).
BROADCAST_GROUPS = 100_000

_UPPER, _LETTER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>@^_=+~{}[]")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0x80:] = True
_DIGIT[48:58] = True


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs in two arrays, and the shape features of each document.

    A feature is 44 bits of a word's hash, or of the hash of a longer word's beginning; the lowest bit tells which.
    """
    data, starts = w.text_bytes(texts)
    docs = len(starts) - 1
    runs, lines = w.Runs(data, starts), w.Runs(data, starts, w.NEWLINE, w.SAME)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (sums[starts[1:]] - sums[starts[:-1]]).astype(float)

    bare = w.Runs(data, starts, w.BREAK, prefixes=PREFIXES)
    sizes, parts = bare.ends - bare.starts, [(bare.doc, bare.hash, 0)]
    for k, heads in zip(PREFIXES, bare.prefixes, strict=True):
        parts.append((bare.doc[sizes > k], heads[sizes > k], 1))
    key = np.sort(np.concatenate([(d.astype(w.U64) << BITS) | (h >> (w.U64(64) - BITS)) & ~w.U64(1) | w.U64(kind) for d, h, kind in parts]))
    key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
    doc, word = (key >> BITS).astype(np.int64), key & ((w.U64(1) << BITS) - w.U64(1))
    n = np.maximum(w.per_doc(runs.doc, docs), 1)
    chars = np.maximum(count(~w.SPACE[data]), 1)
    letters, letter_sums = count(_LETTER[data]), np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    _, again = w.repeated(lines.doc, lines.hash)
    stutter = (runs.hash[1:] == runs.hash[:-1]) & (runs.doc[1:] == runs.doc[:-1])
    keys, at = w.windows(runs.hash, runs.doc, 8)
    twice, _ = w.repeated(runs.doc[at], keys)
    shape = np.column_stack([
        letters / chars,
        count(_UPPER[data]) / np.maximum(letters, 1),
        count(_DIGIT[data]) / chars,
        w.per_doc(runs.doc[letter_sums[runs.ends] == letter_sums[runs.starts]], docs) / n,
        w.per_doc(doc[word & w.U64(1) == 0], docs) / np.maximum(w.per_doc(bare.doc, docs), 1),
        w.per_doc(lines.doc[again], docs) / np.maximum(w.per_doc(lines.doc, docs), 1),
        w.per_doc(runs.doc[1:][stutter], docs) / n,
        w.per_doc(runs.doc[at][twice], docs) / n,
        np.log(n) / 10,
        count(_SYMBOL[data]) / chars,
        count(_SYMBOL[data]) > 0.1 * chars,
    ])
    return doc, word, shape


@dataclass(frozen=True)
class Model:
    """Two logistic heads over a sorted vocabulary of word hashes and the shape features."""

    vocabulary: np.ndarray
    words: np.ndarray  # heads x vocabulary
    shape: np.ndarray  # heads x (shape features + intercept)
    rates: tuple[float, float]  # the positive share each head was fitted with

    def logits(self, texts: pa.Array) -> np.ndarray:
        doc, word, shape = _features(texts)
        at = np.minimum(np.searchsorted(self.vocabulary, word), max(0, len(self.vocabulary) - 1))
        known = self.vocabulary[at] == word if len(self.vocabulary) else np.zeros(len(word), bool)
        doc, at = doc[known], at[known]
        known = np.maximum(w.per_doc(doc, len(shape)), 1)
        dense = np.column_stack([shape, np.ones(len(shape))]) @ self.shape.T
        return np.column_stack([dense[:, h] + np.bincount(doc, self.words[h][at], len(shape)) / known ** DAMPING[h] for h in range(2)])


def _fit_head(rows: np.ndarray, cols: np.ndarray, size: int, shape: np.ndarray, y: np.ndarray, damping: float, rounds: int = 200, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch logistic regression (Adam) on presence / known words ** damping and shape.

    Presence counts as much as the feature's log ratio between the two classes, so the ridge falls on features
    that tell nothing, not on the few that do.
    """
    dense = np.column_stack([shape, np.ones(len(shape))])
    theta = np.zeros(size + dense.shape[1])
    if len(y) == 0 or y.min() == y.max():
        return theta[:size], theta[size:]
    with_it = [np.bincount(cols, side[rows], size) for side in (y, 1 - y)]
    ratio = np.abs(np.log((with_it[0] + 0.5) / (y.sum() + 1)) - np.log((with_it[1] + 0.5) / ((1 - y).sum() + 1)))
    value = ratio[cols] * (np.maximum(np.bincount(rows, minlength=len(y)), 1.0) ** -damping)[rows]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        margin = np.bincount(rows, value * theta[cols], len(y)) + dense @ theta[size:]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        slope = np.concatenate([np.bincount(cols, value * error[rows], size), dense.T @ error]) + ridge * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta -= 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:size] * ratio, theta[size:]


def fit(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6000, max_vocabulary: int = 60_000, min_docs: int = 8, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits both heads (good: label ``quality``; toxic: label ``toxic``) on a bounded sample.

    ``max_train_rows`` bounds the labelled rows that are used, however many there are; the words
    kept are those in at least ``min_docs`` of them (a hundredth of them, if that is less, and two at least), the commonest first up to
    ``max_vocabulary``. Words are counted by Spark; what comes to the driver is the kept words and, of each row, which it has.
    An id that is labelled several times has its largest labels, one with several texts its smallest text.
    """
    sample = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("double").alias("good"), F.col("toxic").cast("double").alias("toxic")).dropna()
    sample = sample.groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_train_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("good").alias("good"), F.first("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                doc, word, shape = _features(part.column("text"))
                ends = np.concatenate(([0], np.cumsum(w.per_doc(doc, len(shape)))))
                yield pa.RecordBatch.from_arrays([
                    part.column("good"), part.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(shape) + 1) * SHAPE, pa.int32()), pa.array(shape.ravel())),
                ], ["good", "toxic", "words", "shape"])

    found = cut(joined.mapInArrow(run, "good double, toxic double, words array<long>, shape array<double>"))
    least = max(2, min(min_docs, found.count() // 100))
    counts = found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    vocabulary = np.sort(np.asarray(counts.orderBy(F.desc("n"), "word").limit(max_vocabulary).select("word").toArrow()["word"]).astype(np.int64).view(w.U64))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            words = np.asarray(lists.flatten()).view(w.U64)
            at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
            has = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()).astype(np.int64))
            ends = np.concatenate(([0], np.cumsum(w.per_doc(owner[has], batch.num_rows))))
            yield batch.set_column(batch.schema.get_field_index("words"), "words", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[has].astype(np.int32))))

    got = found.mapInArrow(known, "good double, toxic double, words array<int>, shape array<double>").toArrow()
    sizes = np.asarray(got["words"].combine_chunks().value_lengths()).astype(np.int64) if got.num_rows else np.empty(0, np.int64)
    cols = np.asarray(got["words"].combine_chunks().flatten()).astype(np.int64) if got.num_rows else np.empty(0, np.int64)
    shape = np.asarray(got["shape"].combine_chunks().flatten()).reshape(-1, SHAPE) if got.num_rows else np.empty((0, SHAPE))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    targets = [np.asarray(got[c]).astype(float) if got.num_rows else np.empty(0) for c in ("good", "toxic")]
    heads = [_fit_head(rows, cols, len(vocabulary), shape, y, d) for y, d in zip(targets, DAMPING, strict=True)]
    rates = tuple(float(min(0.99, max(0.01, y.mean()))) if len(y) and y.min() < y.max() else 0.5 for y in targets)
    return Model(vocabulary, np.stack([h[0] for h in heads]), np.stack([h[1] for h in heads]), rates)


def _scores(docs: DataFrame, model: Model, keep: Sequence[Column], text_col: str, with_text: bool = False) -> DataFrame:
    """``keep`` columns (and the text) with ``own_good`` and ``own_toxic``, the document's own probabilities."""
    head = docs.select(F.struct(*keep).alias("kept"), F.col(text_col).cast("string").alias("text"))
    names = ["kept", "own_good", "own_toxic"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                p = 1 / (1 + np.exp(-np.clip(model.logits(part.column("text")), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(p[:, 0]), pa.array(p[:, 1])] + [part.column("text")] * with_text, names)

    return head.mapInArrow(run, StructType([head.schema["kept"], StructField("own_good", DoubleType()), StructField("own_toxic", DoubleType())] + [head.schema["text"]] * with_text))


def _shrunk(groups: DataFrame, above: Column, strength: float) -> DataFrame:
    return groups.withColumn("p", (above * strength + F.col("good")) / (F.lit(strength) + F.col("n")))


def _strength(groups: DataFrame, centre: Column) -> float:
    """Beta prior strength by moments: the spread between groups beyond what sampling explains."""
    mean = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * (mean - centre) ** 2).alias("spread"), F.sum(F.col("n") * centre * (1 - centre)).alias("noise"),
    ).first()
    if not row["n"] or not row["spread"]:
        return 1e4
    within = row["noise"] / row["n"]
    between = max((row["spread"] - row["groups"] * within) / row["n"], within / 1e4)
    return min(max(within / between - 1, 1.0), 1e4)


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Posterior share of good documents for each (host, path), each shrunk to its host and that to all."""
    paths = cut(scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum("own_good").alias("good")))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    centre = F.lit((whole["good"] + 1) / (whole["n"] + 2) if whole["n"] else 0.5)
    hosts = cut(_shrunk(hosts, centre, _strength(hosts, centre)).select(host, F.col("p").alias("p_host")))
    paths = paths.join(hosts, host)
    return cut(_shrunk(paths, F.col("p_host"), _strength(paths, F.col("p_host"))).select(host, path, "p_host", F.col("p").alias("p_path")))


def _key(*columns: str) -> Column:
    """A never-null string for a tuple of values that may be null."""
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in columns)) if columns else F.lit("")


def classify(docs: DataFrame, labels: DataFrame, keep: Sequence[str] | None = None, host_cols: Sequence[str] = ("source",), path_cols: Sequence[str] = ("lang",), threshold: float = 0.5, toxic_threshold: float = 0.35, text_col: str = "text", model: Model | None = None, **fitting) -> DataFrame:
    """Columns ``keep`` of docs (default: all) in the struct ``row``, with the evidence of each level.

    ``own_good``, ``p_host``, ``p_path``, ``p_good`` (own odds moved by the path's), ``own_toxic``
    and ``accepted``: ``p_good`` at least ``threshold`` and ``own_toxic`` below ``toxic_threshold``.
    """
    model = model or fit(small_batches(docs), labels, text_col=text_col, **fitting)
    host, path = _key(*host_cols), _key(*path_cols)
    keep = list(docs.columns if keep is None else keep)
    scored = _scores(docs, model, [beside_text(docs, keep, text_col), host.alias("host"), path.alias("path")], text_col, text_col in keep)
    scored = scored.select("kept.host", "kept.path", *(["text"] if text_col in keep else []), F.col("kept.row").alias("row"), "own_good", "own_toxic")
    if text_col not in keep:  # small rows: score once; else a second look at the texts beats writing them
        scored = cut(scored)
        sites = site_posteriors(scored)
    else:
        sites = site_posteriors(_scores(docs, model, [host.alias("host"), path.alias("path")], text_col).select("kept.*", "own_good"))
    few = sites.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    rate, logit = model.rates[0], lambda p: F.log(p / (1 - p))
    safe = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = logit(safe("own_good")) + logit(safe("p_path")) - F.lit(float(np.log(rate / (1 - rate))))
    out = scored.join(F.broadcast(sites) if few else sites, ["host", "path"]).withColumn("p_good", 1 / (1 + F.exp(-odds)))
    accepted = (F.col("p_good") >= threshold) & (F.col("own_toxic") < toxic_threshold)
    return out.select(whole_row(docs, keep, text_col), "own_good", "p_host", "p_path", "p_good", "own_toxic", accepted.alias("accepted"))
