"""Best-fit packing of token sequences under several capacities.

A bin has a residual vector: tokens, documents and attention cost (the sum of squared piece
lengths, as attention stays within pieces). Pieces come longest first; of the bins that hold
a piece under every constraint, the one is chosen whose residual after it has the smallest
weighted norm, or the largest weighted dot-product with the piece. Only a document longer
than the token capacity is cut.

Pieces are dealt into groups of about ``group_pieces`` that are packed on their own, so at most
the last bins of a group stay open; with thousands of pieces a group that is a fraction of a per
mille. The default document and attention capacities are those that the token capacity
implies, so they steer the choice and never cost a sequence; lower ones bind.

Defined results: a null or empty text is its end token alone; repeated rows are packed each;
an empty table gives an empty result; extra columns are ignored, or kept in ``row`` if named.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from . import words as w
from .common import small_batches
from .token_ids import encoder

WEIGHTS = (1.0, 0.01, 0.05)
#: Distinct words whose ids a worker remembers; fewer than the token store's, as packing comes last in a pipeline of other work.
REMEMBERED = 300_000


def best_fit(lengths: np.ndarray, tokens: int, docs: int, cost: int, weights: Sequence[float] = WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its offset there; ``by`` is "norm" or "dot"."""
    scale = np.sqrt(np.array(weights)) / np.array([tokens, docs, cost], float)
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.empty((1024, 3), np.int64)  # open bins: what is left of each capacity
    name = np.empty(1024, np.int64)
    opened = used = 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order:
        n = int(lengths[i])
        item = np.array([n, 1, n * n])
        live = left[:used]
        fits = np.flatnonzero((live >= item).all(axis=1))
        if len(fits):
            if by == "norm":
                merit = -(((live[fits] - item) * scale) ** 2).sum(axis=1)
            else:
                merit = (live[fits] * scale) @ (item * scale)
            b = int(fits[np.argmax(merit)])
        else:
            if used == len(left):
                left, name = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)])
            b, used = used, used + 1
            left[b], name[b] = (tokens, docs, cost), opened
            opened += 1
        where[i], offset[i] = name[b], tokens - left[b, 0]
        left[b] -= item
        if left[b, 0] < smallest or left[b, 1] < 1 or left[b, 2] < smallest * smallest:  # full: the last bin takes its place
            used -= 1
            left[b], name[b] = left[used], name[used]
    return where, offset


def _pieces(docs: DataFrame, file: str, end: int, tokens: int, keep: Sequence[str], text_col: str, with_ids: bool) -> DataFrame:
    head = docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), F.col(text_col).cast("string").alias("text"))
    names = ["row", "piece", "start", "length", "ids_crc32", "slot"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, slot = encoder(file, REMEMBERED), 0
        for batch in batches:
            for part in w.slices(batch, "text"):
                ids, at = coder.encode(part.column("text"), end)
                raw, sizes = ids.astype("<u4"), np.diff(at)
                many = -(-sizes // tokens)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * tokens
                length = np.minimum(tokens, sizes[row] - start)
                begin = at[row] + start
                view = memoryview(raw.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column("row").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(slot + np.arange(len(row)))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(raw.astype(np.int32))))
                slot += len(row)
                yield pa.RecordBatch.from_arrays(cols, names)

    fields = [head.schema["row"], StructField("piece", IntegerType()), *(StructField(c, LongType()) for c in names[2:6])]
    return head.mapInArrow(run, StructType(fields + [StructField("ids", ArrayType(IntegerType()))] * with_ids))


def pack(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text_col: str = "text", file: str = "word_bpe_49k.json", end: int = 0, tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None, weights: Sequence[float] = WEIGHTS, by: str = "norm", group_pieces: int | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: ``row`` (columns ``keep``), piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids.

    ``group_pieces`` is 20,000, or 4,000 where ids are in the groups too (at most 32 MB of them).
    """
    group_pieces = group_pieces or (4_000 if with_ids else 20_000)
    small_batches(docs)
    docs_cap, cost_cap = max_docs or tokens, max_cost or tokens * tokens
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()
    groups = 1 + int((size["n"] + (size["bytes"] or 0) / (2.5 * tokens)) // group_pieces)
    pieces = _pieces(docs, file, end, tokens, keep, text_col, with_ids)
    pieces = pieces.withColumn("deal", F.pmod(F.xxhash64("slot", "ids_crc32", "start"), F.lit(groups)).cast("int"))
    schema = StructType([f for f in pieces.schema.fields if f.name not in ("slot", "deal")] + [StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(key, table):
        table = table.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "start", "slot")])  # the same whatever order rows come in
        where, offset = best_fit(np.asarray(table["length"]), tokens, docs_cap, cost_cap, weights, by)
        first = table["deal"][0].as_py() << 32
        w.trim()
        return table.drop_columns(["slot", "deal"]).append_column("sequence_id", pa.array(first + where)).append_column("offset", pa.array(offset))

    return pieces.groupBy("deal").applyInArrow(run, schema)
