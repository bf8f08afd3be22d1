"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct n-word shingles. XOR-hashing the set into a bit sketch
toggles one bit a shingle, so the Hamming distance of two sketches is at most the size of the
sets' symmetric difference. Sets with Jaccard similarity of p/q or more and sizes a and b differ in
at most ``D = (a + b)(q - p) // (q + p)`` shingles, so of ``S > D`` segments of their sketches ``S - D`` agree
at least (pigeonhole). Sizes are banded so that partners lie in the same band or the next, each document
sends its segments to both, and segments that agree propose pairs, which are verified on the whole
sets. Segments are sparse and wide, so by chance only empty ones agree; with ``S - D`` above one, a
document need not send its empty segments unless it has ``S - D`` of them.

Nothing emits all pairs of a group. Equal sets are one class from the start. In a bucket of
equal segments each class is proposed to the bucket's first and to the one before it; proposals that short folded sketches rule out go, the rest is verified, and
then, exactly, every pair of a bucket that is still in different components and that folded
sketches cannot rule out, tile by tile. Pairs within a component need no look, as a link between them changes nothing.

Defined results: a text of fewer than n words is one shingle; a text without words, or null,
has none and links with nothing; repeated rows are one vertex (an id names one text); a null id
links with nothing and gets a null component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.components import components

from . import words as w
from .common import cut, settled, small_batches, tasks

#: Ids up to which a list of ids is broadcast to filter a table (16 bytes or so each).
BROADCAST_IDS = 500_000
#: Classes of a bucket that are compared in one tile.
TILE = 1024
#: Distinct sets that a task remembers in order to send equal ones once.
REMEMBERED = 500_000


class Bands:
    """Size bands for similarity of at least ``p / q``: partners are in one band or the next.

    ``differ`` is how much a set of each band and a partner of its size or more, in this band or the next, may differ.
    """

    def __init__(self, p: int, q: int, largest: int):
        self.p, self.q = p, q
        lows = [1]
        while lows[-1] <= largest:
            lows.append(lows[-1] * q // p + 1)
        self.lows = np.array(lows, np.int64)
        self.differ = np.append(self.least(self.lows[1:] - 1), 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, "right") - 1

    def least(self, sizes: np.ndarray) -> np.ndarray:
        """How much sets of these sizes may differ from larger partners."""
        return (sizes + sizes * self.q // self.p) * (self.q - self.p) // (self.q + self.p)

    def most(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How much sets of these sizes may differ from smaller partners in a band."""
        return (sizes + self.lows[band + 1] - 1) * (self.q - self.p) // (self.q + self.p)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, document by document, and the document of each (sorted)."""
    data, starts = w.text_bytes(texts)
    runs = w.Runs(data, starts)
    keys, at = w.windows(runs.hash, runs.doc, n)
    doc = runs.doc[at]
    sizes = w.per_doc(runs.doc, len(starts) - 1)
    few = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(few):
        first = np.searchsorted(runs.doc, few)
        whole = np.zeros(len(few), w.U64)
        for k in range(n - 1):
            has = sizes[few] > k
            whole[has] = whole[has] * w.BASE + runs.hash[first[has] + k]
        keys, doc = np.append(keys, w.mix(whole ^ sizes[few].astype(w.U64))), np.append(doc, few)
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[fresh], doc[fresh]


def _signatures(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each document's set and two 64-bit sums that stand for it."""
    sizes = w.per_doc(doc, docs)
    one, two = np.zeros(docs, w.U64), np.zeros(docs, w.U64)
    some = np.flatnonzero(sizes)
    if len(some):
        at = (np.cumsum(sizes) - sizes)[some]
        one[some], two[some] = np.add.reduceat(keys, at), np.add.reduceat(w.mix(keys ^ w.MIX1), at)
    return sizes, one, two


def parity_sketch(keys: np.ndarray, doc: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashed segments of every document's sketch in one array, which of them have a shingle, and where each document's begin.

    Keys are sorted by document and key. A shingle's segment is the range that its key is in; XOR of the hashes
    of a segment's shingles stands for its bits (two segments with different bits hash differently).
    """
    begin = np.concatenate(([0], np.cumsum(segments)))
    place = begin[doc] + (((keys >> w.U64(32)) * segments[doc].astype(w.U64)) >> w.U64(32)).astype(np.int64)
    out, used = np.zeros(int(begin[-1]), w.U64), np.zeros(int(begin[-1]), bool)
    if len(place):
        heads = np.flatnonzero(np.append(True, np.diff(place) > 0))
        out[place[heads]], used[place[heads]] = np.bitwise_xor.reduceat(w.mix(keys ^ w.MIX2), heads), True
    return out, used, begin


def _folded(keys: np.ndarray, doc: np.ndarray, docs: int) -> list[bytes]:
    """For each document a sketch of about two bits a shingle, a power of two long, that halves by XOR."""
    sizes = np.maximum(w.per_doc(doc, docs), 1)
    segments = 2 ** np.maximum(0, np.ceil(np.log2(sizes / 32))).astype(np.int64)
    begin = np.concatenate(([0], np.cumsum(segments)))
    place = (keys % (segments[doc] * 64).astype(w.U64)).astype(np.int64)
    bits = np.bincount(begin[doc] * 64 + place, minlength=int(begin[-1]) * 64)
    packed = np.packbits((bits & 1).astype(bool), bitorder="little").tobytes()
    return [packed[8 * a : 8 * b] for a, b in zip(begin[:-1], begin[1:], strict=True)]


def _bucket_rows(ids: np.ndarray, keys: np.ndarray, doc: np.ndarray, sizes: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, ...]]:
    out = []
    own = bands.of(np.maximum(sizes, 1))
    for step in (0, 1):
        band = np.maximum(own - step, 0)
        sent = bands.most(sizes, band) if step else bands.least(sizes)
        # sets that differ in nothing are equal, and so one class already
        segments = np.where((sizes > 0) & (own >= step) & (sent > 0), bands.differ[band] + 2 + bands.differ[band] // 16, 0)
        mine = segments[doc] > 0
        if not mine.any():
            continue
        sketch, used, _ = parity_sketch(keys[mine], doc[mine], segments)
        owner = np.repeat(np.arange(len(sizes)), segments)
        firsts = np.cumsum(segments) - segments
        number = np.arange(len(owner)) - firsts[owner]
        key = w.mix(sketch ^ w.mix(band[owner].astype(w.U64) * w.U64(1 << 32) + number.astype(w.U64)))
        rank = owner.astype(w.U64) << w.U64(41) | (~used).astype(w.U64) << w.U64(40) | key >> w.U64(24)
        order = np.argsort(rank)
        chosen = order[number <= sent[owner]]  # in this order, too, owners follow each other
        out.append((key.view(np.int64)[chosen], ids[owner[chosen]]))
    return out


def _signed(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                sizes, one, two = _signatures(*shingle_sets(part.column("text"), n), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["id", "n", "one", "two"])

    return docs.mapInArrow(run, "id long, n long, one long, two long")


def _segments(docs: DataFrame, n: int, bands: Bands) -> DataFrame:
    """(key, id): the band, number and value of a segment, hashed, and a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = w.Places()
        for batch in batches:
            for part in w.slices(batch, "text"):
                keys, doc = shingle_sets(part.column("text"), n)
                sizes, one, two = _signatures(keys, doc, part.num_rows)
                stands = np.maximum(w.mix(one ^ w.mix(two ^ sizes.astype(w.U64))), w.U64(1))
                distinct, at = np.unique(stands, return_index=True)
                new = known.find(distinct) < 0
                fresh = np.zeros(part.num_rows, bool)
                fresh[at[new]] = True
                if known.size > REMEMBERED:
                    known = w.Places()
                known.add(distinct[new] if known.size else distinct)
                sizes = np.where(fresh, sizes, 0)
                ids = np.asarray(part.column("id"))
                mine = fresh[doc]
                for key, owner in _bucket_rows(ids, keys[mine], doc[mine], sizes, bands):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], ["key", "id"])

    return docs.mapInArrow(run, "key long, id long")


def _shared(rows: DataFrame) -> DataFrame:
    """Of rows sorted by key, those whose key has more rows, with the first and the preceding id of the key."""

    names = ["key", "id", "first", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its columns as in names, and whether it shares its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = np.asarray(batch.column("key")), np.asarray(batch.column("id"))
            if held:
                key, ids = np.append(held[0], key), np.append(held[1], ids)
            same = key[1:] == key[:-1]
            as_prev, as_next = np.append(bool(held and held[4]), same), np.append(same, False)
            group = np.cumsum(np.append(False, ~same))
            first = ids[np.flatnonzero(np.append(True, ~same))][group]
            before = np.where(as_prev, np.append(ids[0], ids[:-1]), ids)
            if held:
                first[group == 0], before[0] = held[2], held[3]
            held = (key[-1], ids[-1], first[-1], before[-1], bool(as_prev[-1]))
            out = np.flatnonzero((as_prev | as_next)[:-1])
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, ids, first, before)], names)
        if held and held[4]:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:4]], names)

    return rows.mapInArrow(run, "key long, id long, first long, before long")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is among ids: by broadcast when those are few enough, else by a shuffled join."""
    return docs.join(_small_ids(ids), "id", "left_semi")


def _small_ids(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _whole_sets(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                keys, doc = shingle_sets(part.column("text"), n)
                ends = np.concatenate(([0], np.cumsum(w.per_doc(doc, part.num_rows))))
                lists = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists, pa.array(_folded(keys, doc, part.num_rows), pa.binary())], ["id", "set", "sketch"])

    return docs.mapInArrow(run, "id long, set array<long>, sketch binary")


def _distances(left: pa.BinaryArray, right: pa.BinaryArray) -> np.ndarray:
    """Hamming distances of folded sketches; the longer one of two is folded to the other's length."""
    sides = []
    for column in (left, right):
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
        sides.append((np.frombuffer(data, np.uint8), ends[:-1], np.diff(ends)))
    out = np.empty(len(left), np.int64)
    shapes = sides[0][2] << 32 | sides[1][2]
    for shape in np.unique(shapes):
        at = np.flatnonzero(shapes == shape)
        words = min(int(shape) >> 32, int(shape) & 0xFFFFFFFF) // 8
        folded = []
        for data, begin, size in sides:
            long = int(size[at[0]])
            rows = np.ascontiguousarray(data[begin[at][:, None] + np.arange(long)]).view(w.U64)
            folded.append(np.bitwise_xor.reduce(rows.reshape(len(at), -1, words), axis=1))
        out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1)
    return out


def _possible(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (with their other columns) whose folded sketches are not too far apart; sends no whole sets."""
    ends = sets.select("id", F.size("set").cast("long").alias("n"), "sketch")
    for c in ("a", "b"):
        pairs = pairs.join(ends.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = _distances(batch["sketch_a"], batch["sketch_b"])
            bound = (np.asarray(batch["n_a"]) + np.asarray(batch["n_b"])) * (q - p) // (q + p)
            yield batch.select(["a", "b", "times"]).filter(pa.array(apart <= bound))

    return pairs.mapInArrow(run, "a long, b long, times long")


def _verified(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = _only(sets.select("id", "set"), ids)
    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("left")), sets.select(F.col("id").alias("b"), F.col("set").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", both)
    return joined.where(q * F.col("both") >= p * (F.size("left") + F.size("right") - F.col("both"))).select("a", "b")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs whose ends have different roots, with those; ``roots`` has (id, root) for all but the roots themselves."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    differ = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return pairs.where(differ)


def _unresolved(shared: DataFrame, classes: DataFrame, roots: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs of one bucket in different components that folded sketches leave possible, compared in tiles."""
    by_class = shared.select("key", "id").join(classes, "id", "left").select("key", F.coalesce("rep", "id").alias("id")).distinct()
    rooted = by_class.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high")
    tiles = mixed.select("key", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    rows = rooted.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    meets = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    rows = rows.withColumn("other", meets).select("key", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "id", "root")
    rows = rows.join(sets.select("id", F.size("set").cast("long").alias("n"), "sketch"), "id")

    def run(key, table):  # at most two tiles
        table = table.combine_chunks()
        ids, root, n = (np.asarray(table[c]) for c in ("id", "root", "n"))
        sketch = [np.frombuffer(x, w.U64) for x in table["sketch"].to_pylist()]
        long = np.array([len(x) for x in sketch])
        a_out, b_out = [], []
        for size in np.unique(long):  # the larger sketch of a pair is folded to the smaller's length
            wide = np.flatnonzero(long >= size)
            flat = np.stack([np.bitwise_xor.reduce(sketch[i].reshape(-1, size), axis=0) for i in wide])
            for row in np.flatnonzero(long[wide] == size):
                apart = np.bitwise_count(flat ^ flat[row]).sum(axis=1, dtype=np.int64)
                i = wide[row]
                ok = (apart <= (n[wide] + n[i]) * (q - p) // (q + p)) & (root[wide] != root[i]) & ((long[wide] > size) | (ids[wide] > ids[i]))
                a_out.append(np.minimum(ids[wide[ok]], ids[i]))
                b_out.append(np.maximum(ids[wide[ok]], ids[i]))
        w.trim()
        return pa.table({"a": pa.array(np.concatenate(a_out), pa.int64()), "b": pa.array(np.concatenate(b_out), pa.int64())})

    return rows.groupBy("key", "t", "u").applyInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, p: int = 9, q: int = 10) -> DataFrame:
    """(id, n_shingles, component_id) for every row: components of links with Jaccard similarity p/q or more."""
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(_signed(texts, n))
    known = signed.where("id is not null and n > 0")
    reps = known.groupBy("n", "one", "two").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps, _ = settled(reps.where("copies > 1"))  # so that the join below is of two tables and a hot class can be split
    classes, _ = settled(known.join(reps, ["n", "one", "two"]).where("id != rep").select("id", "rep").distinct())
    largest = signed.agg(F.max("n")).first()[0] or 0
    keyed = _segments(texts.where("id is not null"), n, Bands(p, q, largest))
    keyed = keyed.repartition(tasks(docs), "key").sortWithinPartitions("key", "id")
    shared = cut(_shared(keyed))

    proposed = shared.select("id", F.explode(F.array("first", "before")).alias("other")).where("id != other")
    proposed = proposed.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    for c in ("a", "b"):
        proposed = proposed.join(classes.select(F.col("id").alias(c), F.col("rep").alias(f"rep_{c}")), c, "left").withColumn(c, F.coalesce(f"rep_{c}", c)).drop(f"rep_{c}")
    pairs = proposed.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("times").alias("times"))
    ids = shared.select("id").join(classes, "id", "left").select(F.coalesce("rep", "id").alias("id")).distinct()
    sets = cut(_whole_sets(_only(texts, ids), n))
    pairs, _ = settled(_possible(pairs, sets, p, q))
    roots, _ = settled(components(_verified(pairs, sets, p, q)))
    more, left = settled(_unresolved(shared, classes, roots, sets, p, q))
    if left:
        between = _rooted(_verified(more, sets, p, q), roots).select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(between).select(F.col("id").alias("root"), F.col("root").alias("next"))
        # what had no root of its own may be a root that got one
        roots = roots.join(joined, "root", "left").select("id", F.coalesce("next", "root").alias("root")).union(joined.select("root", "next"))
        roots, _ = settled(roots)
    members = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    roots = roots.union(members)
    roots = roots.groupBy("id").agg(F.min("root").alias("root"))
    out = signed.select("id", F.col("n").alias("n_shingles")).join(roots, "id", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.least("id", F.coalesce("root", "id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """One row of docs, all its columns, for each component: that with the smallest id.

    Rows that share an id are one document, of which the row with the smallest text stays; rows without an id all stay.
    """
    kept = linked(docs, id_col, text_col, n, p, q).select(F.col(id_col).alias("id"), "component_id").where("id = component_id")
    ids = kept.groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
    ids, _ = settled(ids)
    row = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    small = _small_ids(ids)
    single = row.join(small.where("rows = 1"), "id", "left_semi").select("row")
    several = row.join(small.where("rows > 1"), "id", "left_semi").groupBy("id").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row")
    return single.union(several).union(row.where("id is null").select("row")).select("row.*")
