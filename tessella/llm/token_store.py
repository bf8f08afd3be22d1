"""Token-id store: whole texts as ids, in ascending document order, coded in blocks.

Documents are range-partitioned by id (and text, so that even one id's rows can be dealt out),
sorted, encoded and written as shards. A shard row has the ids and token counts of its documents
and its blocks of ``id_coder``, each of which can be read by itself and is checked when read.
Shards are written as a Parquet table, so any store that Spark writes to will do. A range of
shards, and within one a range of blocks, can be read alone.

Defined results: a null or empty text is its end token alone; null ids come first; repeated rows
are stored each; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import id_coder
from . import words as w
from .common import cut, small_batches, tasks
from .token_ids import SLICE, encoder

#: Ids of a shard row, at most (one document may have more); so many blocks are coded in step.
SHARD_IDS = 8 << 20
#: Shard rows up to which the table of their places is broadcast (24 bytes each).
BROADCAST_ROWS = 500_000


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", file: str = "word_bpe_49k.json", end: int = 2) -> None:
    """Encodes and writes all rows; each text's ids are followed by ``end``."""
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks(docs), "id", "tie").sortWithinPartitions("id", "tie").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, part = encoder(file), TaskContext.get().partitionId(), 0
        names, sizes, ids, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            blocks = id_coder.encode(np.concatenate(ids))
            n = np.concatenate(sizes)
            cols = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([int(n.sum())], pa.int64())]
            lists = [pa.chunked_array(names).combine_chunks(), pa.array(n, pa.int64()), pa.array(blocks, pa.binary())]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(cols, ["shard", "part", "n_ids", "docs", "n_tokens", "blocks"])

        for batch in batches:
            for piece in w.slices(batch, "text", SLICE):
                got, at = coder.encode(piece.column("text"), end)
                if held and held + len(got) > SHARD_IDS:
                    yield row()
                    names, sizes, ids, held, part = [], [], [], 0, part + 1
                names.append(piece.column("id"))
                sizes.append(np.diff(at))
                ids.append(got.astype(np.uint16) if got.max(initial=0) < 1 << 16 else got)
                held += len(got)
        if names:
            yield row()

    kind = texts.schema["id"].dataType.simpleString()
    schema = f"shard int, part int, n_ids long, docs array<{kind}>, n_tokens array<long>, blocks array<binary>"
    dealt.mapInArrow(run, schema).write.parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids) of every document; start counts all ids before it."""
    store = spark.read.parquet(path)
    sums = store.groupBy("shard", "part").agg(F.sum("n_ids").alias("n"))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("all"))
    shards = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("ahead"))  # as many rows as the writer had partitions
    within = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    before = cut(sums.withColumn("within", within).join(shards, "shard").select("shard", "part", (F.col("ahead") + F.col("within")).alias("before")))
    few = before.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    store = store.join(F.broadcast(before) if few else before, ["shard", "part"])
    names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.concatenate([np.empty(0, np.int64), *id_coder.decode(row["blocks"][0].as_py())])
                n = row["n_tokens"][0].values.to_numpy()
                ends = np.cumsum(n)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                start = row["before"][0].as_py() + ends - n
                cols = [row["docs"][0].values, pa.array(start), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = store.schema["docs"].dataType.elementType.simpleString()
    return small_batches(store).mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
