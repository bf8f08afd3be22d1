"""Dictionary names in texts, in one pass over each text.

All aliases, folded and cut into words, make one automaton (a trie of words with a link from each state to the longest other one that ends alike). A
text is read word by word with one state, so time is linear in the text however many aliases there are. Guards are phrases (an institution's
word, "homage to") after which a name counts for nothing; they are in the same automaton. Of overlapping names the longest wins, in the same pass.

The automaton goes to every task if the dictionary has ``most_bytes`` at most; a larger one is dealt into parts of that size, one scan each, and overlaps are settled
by text afterwards.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tessella.functions.text import fold
from tessella.sources.storage import small_batches

#: Rows of a batch on its way back.
ROWS = 20_000
Hit = tuple[str, int, int]  # name, first word, number of words


class Automaton:
    """States of a trie over words: what each word leads to, the state to fall back to, and what ends there."""

    def __init__(self, entries: Iterable[tuple[str, str]], guards: Iterable[str] = ()):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, str | None]]] = [[]]  # number of words and name, None for a guard
        for phrase, name in [*entries, *((g, None) for g in guards)]:
            words = phrase.split(" ") if phrase else []
            state = 0
            for word in words:
                if word not in self.next[state]:
                    self.next[state][word] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = self.next[state][word]
            if words and (len(words), name) not in self.ends[state]:
                self.ends[state].append((len(words), name))
        self.back = [0] * len(self.next)
        todo = deque(self.next[0].values())
        while todo:
            state = todo.popleft()
            for word, to in self.next[state].items():
                behind = self.back[state]
                while behind and word not in self.next[behind]:
                    behind = self.back[behind]
                self.back[to] = self.next[behind].get(word, 0)
                self.ends[to] = self.ends[to] + self.ends[self.back[to]]
                todo.append(to)
        self.known = {word for state in self.next for word in state}

    def hits(self, words: Sequence[str]) -> list[Hit]:
        """All names in a text, but those right behind a guard."""
        out: list[Hit] = []
        guarded: set[int] = set()  # places before which a guard ends
        state, known, step, back, ends = 0, self.known, self.next, self.back, self.ends
        for i, word in enumerate(words):
            if word not in known:
                state = 0
                continue
            while state and word not in step[state]:
                state = back[state]
            state = step[state].get(word, 0)
            for n, name in ends[state]:
                if name is None:
                    guarded.add(i + 1)
                elif i + 1 - n not in guarded:
                    out.append((name, i + 1 - n, n))
        return out


def longest_of(hits: Iterable[Hit]) -> list[Hit]:
    """Of overlapping hits the longest, then the earliest, then the first name; the rest follow in that order. Each word is marked once."""
    out, taken = [], set()
    for hit in sorted(hits, key=lambda h: (-h[2], h[1], h[0])):
        place = range(hit[1], hit[1] + hit[2])
        if taken.isdisjoint(place):
            taken.update(place)
            out.append(hit)
    return out


def _schema(kind) -> StructType:
    return StructType([StructField("id", kind), StructField("name", StringType()), StructField("start", IntegerType()), StructField("n_words", IntegerType())])


def _batches(found: Iterator[tuple[object, list[Hit]]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        ids, names, starts, sizes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32())], ["id", "name", "start", "n_words"])

    for ident, hits in found:
        for at in range(0, len(hits), ROWS):
            rows += [(ident, *h) for h in hits[at : at + ROWS]]
            if len(rows) >= ROWS:
                yield batch()
                rows = []
    if rows:
        yield batch()


def _scanned(docs: DataFrame, automaton: Automaton, longest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch) -> Iterator[tuple[object, list[Hit]]]:
            for ident, text in zip(batch.column("id"), batch.column("text"), strict=True):
                hits = automaton.hits((text.as_py() or "").split(" "))
                if hits:
                    yield ident.as_py(), longest_of(hits) if longest else hits

        for batch in batches:
            yield from _batches(found(batch), batch.schema.field("id").type)

    return docs.mapInArrow(run, _schema(docs.schema["id"].dataType))


def longest(found: DataFrame, id_col: str) -> DataFrame:
    """Of overlapping spans (id, name, start, n_words) of a text the longest wins, then the earliest, then the first name; the rest follow in that order."""
    rows = found.select(F.col(id_col).alias("id"), "name", F.col("start").cast("int").alias("start"), F.col("n_words").cast("int").alias("n_words"))

    def sweep(table: pa.Table) -> pa.Table:
        hits = longest_of(zip(*(table.column(c).to_pylist() for c in ("name", "start", "n_words")), strict=True))
        return pa.Table.from_batches(list(_batches(iter([(table.column("id")[0].as_py(), hits)]), table.schema.field("id").type)))

    out = rows.groupBy("id").applyInArrow(sweep, _schema(rows.schema["id"].dataType))
    return out.withColumnRenamed("id", id_col)


def spans(docs: DataFrame, id_col: str, text_col: str, aliases: DataFrame, alias: str, name: str, guards: Sequence[str] = (), longest_wins: bool = False, most_bytes: int = 8 << 20) -> DataFrame:
    """(id, name, start, n_words): names whose aliases stand in the folded texts as whole words, and where.

    Null or empty texts and aliases give nothing; repeated rows are scanned each; texts of any length are read whole. ``guards`` are folded as texts are.
    """
    entries = aliases.select(fold(F.col(alias)).alias("gram"), F.col(name).cast("string").alias("name")).where("gram != '' and name is not null").distinct()
    size = entries.agg(F.sum(F.octet_length("gram") + F.octet_length("name")).alias("n")).first().n or 0
    parts = 1 + size // most_bytes
    folded = [r[0] for r in docs.sparkSession.createDataFrame([(g,) for g in guards], "g string").select(fold(F.col("g"))).collect()] if guards else []
    texts = small_batches(docs).select(F.col(id_col).alias("id"), fold(F.col(text_col)).alias("text"))
    out = None
    for part in range(parts):
        own = entries if parts == 1 else entries.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        got = _scanned(texts, Automaton([(r.gram, r.name) for r in own.collect()], folded), longest_wins and parts == 1)  # about most_bytes
        out = got if out is None else out.union(got)
    out = out.withColumnRenamed("id", id_col)
    return longest(out, id_col) if longest_wins and parts > 1 else out
