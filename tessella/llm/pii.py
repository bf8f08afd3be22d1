"""Information-theoretic sanitisation of personal data.

Base patterns find the protected entities: e-mail and IP addresses, card and phone numbers.
The corpus then tells which terms give an entity away: a term in a document with it discloses
it as far as their pointwise mutual information over all documents makes up the entity's own
information content. ``PMI(e; t) / IC(e)`` is 1 for a term that occurs with the entity only, near
0 for a common word. Terms from ``generalise_at`` on are replaced by what kind of word they are,
terms from ``remove_at`` on are removed, wherever they stand, in documents without the entity too,
and only where ``support`` documents back the estimate; the entities themselves are always masked.

Counts run over all documents: in how many each entity, each term of a document with it, and both
occur; an entity in fewer than ``support`` documents has no disclosing term, so its terms are not
counted. Entities that occur in the very same documents (93 bits of their texts' hashes, summed) have the same counts with every term, so one stands for all of them:
a document that lists thousands of addresses, and its copies, are counted once and not once an address. Pairs leave a task in
batches of ``PAIRS``. Places are keyed by the whole text's hash, so copies of a text share one entry.

Defined results: a null or empty text has no spans and stays as it is; repeated rows are
treated alike; terms of one character are not counted and never masked; texts of any length and with any number of entities are taken whole; other columns
pass through in ``row`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from . import words as w
from .common import beside_text, cut, small_batches, whole_row

KINDS = ("email", "ip", "card", "phone")
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("put", StringType())])
#: Table rows up to which a small side is broadcast (under 100 bytes each), and words up to which a filter is.
BROADCAST_ROWS, BROADCAST_WORDS = 200_000, 1_000_000
#: Pairs of an entity and a term that a task holds at once.
PAIRS = 1 << 19
#: Terms whose counts travel together, and tasks whose counts are added up first.
CHUNK_TERMS, TASKS_A_GROUP = 1024, 128
#: Bits of a text's hash in each of three sums, which stay below 64 bits for as many documents as 32 bits count.
SUM_BITS = 31

#: Stands for any entity at all.
ANY = np.int64(-1)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done:  # back over the local part, in steps, so each character is looked at once
            from_ = max(done, start - 64)
            broken = [m.end() for m in _NOT_LOCAL.finditer(text, from_, start)]
            if broken:
                start = from_ = broken[-1]
                break
            start = from_
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in ``KINDS``, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0]) if len(m[0]) <= 40 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _entities(text: str, spans: list[tuple[str, int, int]]) -> set[int]:
    """Hashes of the entities at these spans."""
    out = set()
    for kind, a, b in spans:
        value = text[a:b].lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", text[a:b])
        out.add(xxhash.xxh64_intdigest(f"{kind}:{value}") >> 1)
    return out


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


class _Terms:
    """The terms of two or more characters of all texts: document, hash, and place in code points."""

    def __init__(self, texts: pa.Array):
        self.data, starts = w.text_bytes(texts)
        runs = w.Runs(self.data, starts, w.BREAK)
        before = np.concatenate(([0], np.cumsum(~w.CONTINUATION[self.data])))
        first = before[starts[:-1]][runs.doc]
        start, end = before[runs.starts] - first, before[runs.ends] - first
        some = end - start > 1
        self.doc, self.key = runs.doc[some], runs.hash.view(np.int64)[some]
        self.start, self.end = start[some].astype(np.int32), end[some].astype(np.int32)
        self.bytes = runs.starts[some], runs.ends[some]


def _apart(start: np.ndarray, end: np.ndarray, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Which of the places overlap no span."""
    out = np.ones(len(start), bool)
    for _, a, b in spans:
        out[np.searchsorted(end, a, "right") : np.searchsorted(start, b, "left")] = False
    return out


def _known(df: DataFrame, column: str) -> np.ndarray | None:
    """The column's values, sorted, or none if there are too many to send out."""
    if df.limit(BROADCAST_WORDS + 1).count() > BROADCAST_WORDS:
        return None
    return np.sort(np.array([r[0] for r in df.select(column).collect()], np.int64))


def _is_in(keys: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    if known is None:
        return np.ones(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def _entity_counts(texts: DataFrame) -> DataFrame:
    """(entity, alone, s0, s1, s2): in how many documents each entity occurs, and sums of those documents' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, part = ["entity", "alone", "s0", "s1", "s2"], (1 << SUM_BITS) - 1
        for batch in batches:
            found: dict[int, list[int]] = {}
            for t in map(lambda x: x.as_py(), batch["text"]):
                if spans := base_spans(t):
                    h = xxhash.xxh3_128_intdigest(t.encode())
                    adds = (1, h & part, h >> SUM_BITS & part, h >> 2 * SUM_BITS & part)
                    for e in _entities(t, spans):
                        known = found.setdefault(e, [0, 0, 0, 0])
                        for i, x in enumerate(adds):
                            known[i] += x
            rows = np.array([[e, *x] for e, x in found.items()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5)], names)

    counts = texts.select("text").mapInArrow(run, "entity long, alone long, s0 long, s1 long, s2 long")
    return counts.groupBy("entity").agg(*(F.sum(c).alias(c) for c in ("alone", "s0", "s1", "s2")))


def _pair_batches(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Entities and terms of documents, each entity with each term, summed in batches of about ``PAIRS``."""
    entities, terms, size = [], [], 0

    def summed() -> pa.RecordBatch:
        entity, term = np.concatenate(entities), np.concatenate(terms)
        order = np.lexsort((term, entity))
        entity, term = entity[order], term[order]
        first = np.flatnonzero(np.append(True, (entity[1:] != entity[:-1]) | (term[1:] != term[:-1])))
        counts = np.diff(np.append(first, len(entity)))
        return pa.RecordBatch.from_arrays([pa.array(entity[first]), pa.array(term[first]), pa.array(counts)], ["entity", "term", "together"])

    for mine, keys in pairs:
        step = max(1, PAIRS // max(1, len(keys)))
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            entities.append(np.repeat(some, len(keys)))
            terms.append(np.tile(keys, len(some)))
            size += len(some) * len(keys)
            if size >= PAIRS:
                yield summed()
                entities, terms, size = [], [], 0
    if size:
        yield summed()


def _together(texts: DataFrame, entities: np.ndarray | None) -> DataFrame:
    """(entity, term, together): in how many documents both occur, the term outside all entities; with ANY as the entity, in how many
    of the documents that hold some entity the term occurs."""

    def pairs(part: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = []
        for i, t in enumerate(map(lambda x: x.as_py(), part.column("text"))):
            spans = base_spans(t)
            mine = np.array(sorted(_entities(t, spans)), np.int64) if spans else np.empty(0, np.int64)
            mine = mine[_is_in(mine, entities)]
            if len(mine):
                held.append((i, mine, spans))
        if not held:
            return
        terms = _Terms(part.column("text").take(pa.array([i for i, _, _ in held])))
        at = np.searchsorted(terms.doc, np.arange(len(held) + 1))
        for k, (_, mine, spans) in enumerate(held):
            own = slice(at[k], at[k + 1])
            yield np.append(mine, ANY), np.unique(terms.key[own][_apart(terms.start[own], terms.end[own], spans)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                yield from _pair_batches(pairs(part))

    return texts.select("text").mapInArrow(run, "entity long, term long, together long").groupBy("entity", "term").agg(F.sum("together").alias("together"))


def _hits(texts: pa.Array, known: np.ndarray | None, spans_of: Callable[[int], list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Document, term, start, end and shape of the terms (of ``known``, if given) outside entities."""
    terms = _Terms(texts)
    hit = np.flatnonzero(_is_in(terms.key, known))
    apart, doc = np.ones(len(hit), bool), terms.doc[hit]
    for i in np.unique(doc):
        own = slice(*np.searchsorted(doc, [i, i + 1]))
        apart[own] = _apart(terms.start[hit[own]], terms.end[hit[own]], spans_of(int(i)))
    hit = hit[apart]
    said = [terms.data[a:b].tobytes().decode() for a, b in zip(terms.bytes[0][hit], terms.bytes[1][hit], strict=True)]
    shape = ["number" if x.isdigit() else "name" if x[:1].isupper() else "word" for x in said]
    return terms.doc[hit], terms.key[hit], terms.start[hit], terms.end[hit], shape


def _places(texts: DataFrame) -> DataFrame:
    """Rows (k1, k2, term, start, end, shape) for all terms of all texts, outside entities."""
    names = ["k1", "k2", "term", "start", "end", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                text = part["text"]
                doc, *rest = _hits(text, None, lambda i, text=text: base_spans(text[i].as_py()))
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part["k1"].take(doc), part["k2"].take(doc), *(pa.array(x) for x in rest[:3]), pa.array(rest[3], pa.string())], names)

    return texts.mapInArrow(run, "k1 long, k2 long, term long, start int, end int, shape string").distinct()


def _once_a_document(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of the words of some texts."""
    data, starts = w.text_bytes(part.column("text"))
    runs = w.Runs(data, starts, w.BREAK)
    return runs.doc, runs.hash.view(np.int64)


def _document_counts(texts: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """(term, docs): in how many documents each term (of ``terms``, sorted, if given) occurs; summed in each task first."""
    if terms is not None:
        return _counts_of(texts, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                doc, key = _once_a_document(part)
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                once = np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
                seen, counts = np.unique(key[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts.astype(np.int64))], ["term", "docs"])

    return texts.select("text").mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs"))


def _counts_of(texts: DataFrame, terms: np.ndarray) -> DataFrame:
    """Counts of given terms. A task tells of most of them, so its counts travel as a vector for each ``CHUNK_TERMS`` of them, not as a row a term; vectors are
    added up by ``TASKS_A_GROUP`` tasks, then all, so no group is larger than that many vectors."""
    many = -(-len(terms) // CHUNK_TERMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(many * CHUNK_TERMS, np.int64)
        for batch in batches:
            for part in w.slices(batch, "text"):
                doc, key = _once_a_document(part)
                slot = np.minimum(np.searchsorted(terms, key), max(0, len(terms) - 1))
                hit = terms[slot] == key if len(terms) else np.zeros(len(key), bool)
                pairs = np.unique(doc[hit] * len(terms) + slot[hit])
                total += np.bincount(pairs % max(1, len(terms)), minlength=len(total))
        rows = [(k, v.tobytes()) for k, v in enumerate(total.reshape(many, CHUNK_TERMS)) if v.any()]
        group = TaskContext.get().partitionId() // TASKS_A_GROUP
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([group] * len(rows), pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["chunk", "part", "sums"])

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(CHUNK_TERMS, np.int64)
        for v in table.column("sums"):
            total += np.frombuffer(v.as_buffer(), np.int64)
        return total

    def some(table: pa.Table) -> pa.Table:
        return pa.table([table.column("chunk")[:1], table.column("part")[:1], pa.array([added(table).tobytes()], pa.binary())], ["chunk", "part", "sums"])

    def all_(table: pa.Table) -> pa.Table:
        total, chunk = added(table), table.column("chunk")[0].as_py()
        there = np.flatnonzero(total)
        return pa.table([pa.array(terms[chunk * CHUNK_TERMS + there]), pa.array(total[there])], ["term", "docs"])

    vectors = texts.select("text").mapInArrow(run, "chunk int, part int, sums binary")
    vectors = vectors.groupBy("chunk", "part").applyInArrow(some, "chunk int, part int, sums binary")
    return vectors.groupBy("chunk").applyInArrow(all_, "term long, docs long")


def disclosing_terms(texts: DataFrame, support: int, generalise_at: float, remove_at: float) -> DataFrame:
    """(entity, term, disclosure, removed) for the terms that give an entity away; of entities in the same documents one stands for all."""
    counted = _entity_counts(texts).where(F.col("alone") >= support)
    entities = cut(counted.groupBy("alone", "s0", "s1", "s2").agg(F.min("entity").alias("entity")).select("entity", "alone"))
    together = cut(_together(texts, _known(entities, "entity")).where((F.col("together") >= support) | (F.col("entity") == ANY)))
    n = F.lit(float(max(1, texts.count())))
    content, gives = F.log2(n / F.col("alone")), lambda docs: F.log2(n * F.col("together") / (F.col("alone") * F.col(docs)))
    # a term is in as many documents at least as hold an entity with it, which rules most common words out before all texts are counted
    among = together.where(F.col("entity") == ANY).select("term", F.col("together").alias("among"))
    able = together.where(F.col("entity") != ANY).join(_small(entities), "entity").join(among, "term")
    able = cut(able.where((content > 0) & (gives("among") >= generalise_at * content)).drop("among"))
    counts = _document_counts(texts, _known(able.select("term").distinct(), "term"))
    both = able.join(counts, "term").withColumn("disclosure", gives("docs") / content).where(F.col("disclosure") >= generalise_at)
    return both.select("entity", "term", "disclosure", (F.col("disclosure") >= remove_at).alias("removed"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _masked(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            out += [text[done : s["start"]], s["put"]]
        done = max(done, s["end"])
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, keep: Sequence[str] | None = None, text_col: str = "text", support: int = 2, generalise_at: float = 0.6, remove_at: float = 0.85) -> DataFrame:
    """Columns ``keep`` of docs (default: all) in the struct ``row``, ``spans`` and the ``clean`` text.

    A span has its kind ("term" for what the corpus adds), start and end in code points, and what is put in its place.
    """
    text = F.col(text_col).cast("string")
    keep = list(docs.columns if keep is None else keep)
    texts = small_batches(docs).select(text.alias("text")).select("text", *_key(F.col("text")))
    told = cut(disclosing_terms(texts, support, generalise_at, remove_at).groupBy("term").agg(F.max("removed").alias("removed")))
    row, with_text = beside_text(docs, keep, text_col), text_col in keep
    known, removed = _known(told, "term"), None
    if known is None:  # too many terms to send out: their places are joined to the texts
        put = F.when(F.col("removed"), "").otherwise(F.concat(F.lit("<"), F.col("shape"), F.lit(">")))
        span = F.struct(F.lit("term").alias("kind"), "start", "end", put.alias("put"))
        found = cut(_places(texts).join(told, "term").groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("told")))
        keyed = docs.select(row, text.alias("text")).select("row", "text", *_key(F.col("text")))
        joined = keyed.join(found, ["k1", "k2"], "left").select("row", "text", "told")
    else:
        removed = _known(told.where("removed"), "term")
        joined = docs.select(row, text.alias("text"), F.lit(None).cast(ArrayType(SPAN)).alias("told"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("put", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                spans, clean = [], []
                texts, more = part.column("text").to_pylist(), part.column("told").to_pylist()
                base = [base_spans(t) for t in texts]
                if known is not None:
                    more = [[] for _ in texts]
                    doc, term, start, end, shape = _hits(part.column("text"), known, base.__getitem__)
                    for i, gone, a, b, x in zip(doc.tolist(), _is_in(term, removed).tolist(), start.tolist(), end.tolist(), shape, strict=True):
                        more[i].append({"kind": "term", "start": a, "end": b, "put": "" if gone else f"<{x}>"})
                for text, own, told in zip(texts, base, more, strict=True):
                    own = [{"kind": k, "start": a, "end": b, "put": f"<{k}>"} for k, a, b in own] + (told or [])
                    spans.append(own)
                    clean.append(_masked(text, own) if own else text)
                cols = [part.column("row"), pa.array(spans, kind), pa.array(clean, pa.string())] + [part.column("text")] * with_text
                yield pa.RecordBatch.from_arrays(cols, ["row", "spans", "clean"] + ["text"] * with_text)

    fields = [joined.schema["row"], StructField("spans", ArrayType(SPAN)), StructField("clean", StringType())] + [joined.schema["text"]] * with_text
    return joined.mapInArrow(run, StructType(fields)).select(whole_row(docs, keep, text_col), "spans", "clean")


def summary(sanitised: DataFrame) -> DataFrame:
    """row, the number of spans of each base kind, the base spans' SHA-256, and all spans as text."""
    order = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(F.array_position(order, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    line = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    base = line(F.filter(spans, lambda s: s["kind"] != "term"))
    return sanitised.select("row", *counts, F.sha2(base, 256).alias("base_sha256"), line(spans).alias("spans"))
