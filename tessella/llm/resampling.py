"""Importance resampling towards a target distribution.

Word runs (lower-cased A-Z, words are maximal runs of ASCII letters, digits and anything beyond ASCII) fall into hashed buckets. What
a bucket is worth is how much more of the target's features than of the corpus's lie there; a document's weight is the sum over its
features, and with Gumbel noise from its id the highest scores are a draw without replacement, the same for any partitioning.

The bytes of Arrow string buffers are classed by a lookup table, words begin and end where neighbouring classes differ, and a
table-driven CRC advances by one byte at all starts at once. Per bucket counts of each task are summed, so a table of ``buckets``
rows is what comes to the driver. Ranks are given by range partitions and the number of rows in those before, in no single task.

Defined results: a null or empty text, or one without words, has no features and weight 0, and is not drawn; a null id
counts as an empty one and stands last among equal scores; repeated rows are drawn each on its own, equal scores and ids in any order;
texts of any length are read whole, in pieces; columns beyond ``keep`` are ignored, names may clash; an empty corpus
gives an empty result, an empty target counts as 0 features.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import words as w
from .common import beside_text, small_batches, stored, whole_row

#: Bytes of a feature that all starts advance through together; what is longer goes on alone.
TOGETHER = 64


def _crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(polynomial), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each ``data[start:end]``, advanced at all starts at once."""
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    begin, left = starts[order], -sizes[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(TOGETHER, int(-left[0]) if len(left) else 0)):
        many = int(np.searchsorted(left, -k, "left"))  # those longer than k
        now = state[:many]
        state[:many] = CRC[(now ^ data[begin[:many] + k]) & 0xFF] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(left, -TOGETHER, "left"))):
        state[i] = zlib.crc32(data[begin[i] + TOGETHER : begin[i] - left[i]].tobytes(), int(state[i]))
    out = np.empty(len(order), np.uint32)
    out[order] = state
    return out


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes that end with a separator."""
    at = 0
    while at < len(data):
        to = min(len(data), at + most)
        if to < len(data):
            breaks = np.flatnonzero(w.BREAK[data[at:to]])
            if len(breaks):
                to = at + int(breaks[-1]) + 1
            else:
                while to < len(data) and not w.BREAK[data[to - 1]]:
                    more = np.flatnonzero(w.BREAK[data[to : to + most]])
                    to += int(more[0]) + 1 if len(more) else min(most, len(data) - to)
        yield at, to
        at = to


def features(data: np.ndarray, doc_starts: np.ndarray, n: int, most: int = w.CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Piece by piece: the document of each word, the document and CRC of each run of 1 to n words joined by one space."""
    held = (np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64))  # bytes, ends and documents of the last n - 1 words
    for at, to in _pieces(data, most):
        part = data[at:to]
        inside = ~w.BREAK[part]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        doc = np.searchsorted(doc_starts, starts + at, "right") - 1
        if not len(starts):
            continue
        line = np.full(int(inside.sum()) + len(starts), 32, np.uint8)  # the words, each closed by one space
        number = np.repeat(np.arange(len(starts)), ends - starts)
        line[np.arange(len(number)) + number] = w.LOWER[part[inside]]
        closed = np.cumsum(ends - starts) + np.arange(len(starts))
        carried = len(held[1])
        line, ends_, doc_ = np.concatenate((held[0], line)), np.concatenate((held[1], closed + len(held[0]))), np.concatenate((held[2], doc))
        starts_ = np.concatenate(([0], ends_[:-1] + 1))
        docs_out, crc_out = [], []
        for m in range(1, n + 1):
            last = np.arange(max(carried, m - 1), len(ends_))  # runs that end in a new word
            last = last[doc_[last] == doc_[last - m + 1]]
            docs_out.append(doc_[last])
            crc_out.append(crcs(line, starts_[last - m + 1], ends_[last]))
        yield doc, np.concatenate(docs_out), np.concatenate(crc_out)
        if n > 1:
            first = max(0, len(ends_) - n + 1)
            base = int(starts_[first])
            held = (line[base:], ends_[first:] - base, doc_[first:])


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = 10_000) -> list[int]:
    """Features in each bucket, over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in w.slices(batch, "text"):
                for _, _, crc in features(*w.text_bytes(part.column("text")), n):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    found = small_batches(texts.select(F.col(text_col).cast("string").alias("text"))).mapInArrow(run, "bucket long, n long")
    out = [0] * buckets
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """What a feature in each bucket adds to a weight: thousandths of the log ratio of smoothed shares."""
    k, s_all, t_all = len(corpus), sum(corpus), sum(target)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, keep: Sequence[str], text_col: str = "text", n: int = 1) -> DataFrame:
    """``row`` (columns ``keep``), ``n_words``, ``n_features`` and ``weight`` of every document."""
    sent = docs.select(beside_text(docs, keep, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    back = text_col in keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                rows = part.num_rows
                n_words, n_features, weight = (np.zeros(rows, np.int64) for _ in range(3))
                for word_doc, doc, crc in features(*w.text_bytes(part.column("text")), n):
                    n_words += np.bincount(word_doc, minlength=rows)
                    n_features += np.bincount(doc, minlength=rows)
                    np.add.at(weight, doc, gain[crc % np.uint32(len(gain))])
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, (n_words, n_features, weight)), *([part.column("text")] if back else [])], ["row", "n_words", "n_features", "weight", *(["text"] if back else [])])

    schema = StructType([sent.schema["row"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight")), *([StructField("text", StringType())] if back else [])])
    out = small_batches(sent).mapInArrow(run, schema)
    return out.select(whole_row(docs, keep, text_col), "n_words", "n_features", "weight")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, from the first 32 bits of SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows with ``rank`` from 1 in the given order: sorted by ranges, each row's place in its range after the rows in ranges before.

    The offsets have a row for each shuffle partition; no window spans all rows."""
    placed = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).tolist()
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("rank", place).drop("_part", "_before", "_at")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", keep: Sequence[str] | None = None, n: int = 1, buckets: int = 10_000, seed: int = 2024, min_words: int = 20, percent: int = 10) -> DataFrame:
    """Every document's ``row`` (columns ``keep``, all by default), ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the documents with ``min_words`` words at least, ``percent`` in a hundred are drawn, those with the highest scores; the
    others have no rank. Only ranked rows are sorted, with the columns of ``keep``, so keep an id and join where rows are wide.
    """
    keep = list(docs.columns if keep is None else keep)
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    there = keep if id_col in keep else [*keep, id_col]
    scored = weighted(docs, gain, there, text_col, n).withColumn("score", F.col("weight") + noise(F.col("row")[id_col], seed))
    scored = stored(scored, "weights")
    fit = F.col("n_words") >= min_words
    number = percent * scored.where(fit).count() // 100
    drawn = ranked(scored.where(fit), [F.desc("score"), F.col("row")[id_col].asc_nulls_last()]).withColumn("rank", F.when(F.col("rank") <= number, F.col("rank")))
    out = drawn.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out if there is keep else out.withColumn("row", F.struct(*(F.col("row")[c].alias(c) for c in keep)))


#: CRC-32 byte by byte over each distinct word; the table is built in the statement.
SQL = r"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END, b)) AS crc),
tokens AS (
  SELECT doc_id, false AS target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT NULL, true, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
coded AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM tokens)),
buckets AS (
  SELECT word, xor(list_reduce(list_transform(range(len(code) // 2), lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
  FROM coded, steps),
counts AS (
  SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t, sum(count(*) FILTER (NOT target)) OVER () AS s_all, sum(count(*) FILTER (target)) OVER () AS t_all
  FROM tokens JOIN buckets USING (word) GROUP BY bucket),
worth AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM tokens JOIN buckets USING (word) JOIN worth USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
