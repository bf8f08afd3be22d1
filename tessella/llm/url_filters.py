"""URL filters by a cascade of Bloom filters.

A list of keys and all keys that the corpus can ask for are known, so membership can be exact without the list: a first filter holds the
listed keys, a second one those other keys of the corpus that the first lets through, a third the listed keys that the
second lets through, and so on until nothing passes wrongly. Asking goes down the levels to the first filter that says no.

Keys are dealt by hash into shards of a bounded number of keys, and each shard's cascade is built by one task. Cascades of up to
``limit_bytes`` go to all tasks together; where all are larger, groups of shards are sent one after another, so what a task holds stays bounded and pages are
never joined or shuffled. Keys are told apart by 128 bits of hash; two that agree in all of them, one listed and one not, raise an error.

Rules (``host/path``) fit a host and its subdomains where the path starts with theirs. A page asks for the suffixes and prefixes of the shapes that
rules have, so what it asks for doesn't grow with the number of rules; the longest that is a rule wins (of equal ones that with the longer
host, then the blocking one). Pages that no rule fits are blocked if their host is listed.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits, and is allowed unless the empty host is listed; repeated pages
are judged each; hosts and paths of any length are taken whole; listed nulls are ignored; columns beyond ``keep`` are ignored, names may clash; an empty table
gives an empty result, an empty list blocks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructField, StructType

from .common import beside_text, cut, small_batches, stored, whole_row
from .words import BASE, U64, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a key asks: is it a rule, is it a blocking rule, is it a listed host.
RULE, BLOCKING, LISTED = "r", "b", "h"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    both = [F.regexp_extract(F.coalesce(rest, F.lit("")), p, 1) for p in (r"^([^/?#]*)", r"^[^/?#]*([^?#]*)")]
    return F.translate(both[0], UPPER, LOWER), both[1]


# cascades


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, j: int, bits: np.ndarray) -> np.ndarray:
    """Where the j-th hash of a level points, in a filter of so many bits."""
    seed = U64((2 * level + 1) * int(BASE) % 2**64)
    return (mix(h1 + seed) + U64(j) * (mix(h2 ^ seed) | U64(1))) % bits


def _holds(filled: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int, hashes: int) -> np.ndarray:
    inside, bits = np.ones(len(h1), bool), U64(8 * len(filled))
    for j in range(hashes):
        at = _positions(h1, h2, level, j, bits)
        inside &= (filled[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool)
    return inside


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, bytes]]:
    """Levels (number of hashes, bits) of the cascade that tells listed keys from the others."""
    yes, no, levels = (h1[listed], h2[listed]), (h1[~listed], h2[~listed]), []
    if len(yes[0]) and len(np.intersect1d(*(np.rec.fromarrays(x) for x in (yes, no)))):
        raise ValueError("two keys, one listed and one not, have the same 128 bits of hash")
    while len(yes[0]):
        share = min(0.5, len(yes[0]) / max(1, len(no[0])) / math.sqrt(2)) if not levels else 0.5
        size = max(8, math.ceil(-len(yes[0]) * math.log(share) / math.log(2) ** 2 / 8))
        hashes = max(1, round(8 * size / len(yes[0]) * math.log(2))) if share < 0.5 else 1
        hashes = min(hashes, 24)
        filled = np.zeros(8 * size, np.uint8)
        for j in range(hashes):
            filled[_positions(*yes, len(levels), j, U64(8 * size)).astype(np.int64)] = 1
        packed = np.packbits(filled, bitorder="little")
        levels.append((hashes, packed.tobytes()))
        wrong = _holds(packed, *no, len(levels) - 1, hashes)
        yes, no = (no[0][wrong], no[1][wrong]), yes
    return levels


def _cascades(universe: DataFrame, keys_a_shard: int) -> tuple[DataFrame, int]:
    """The levels of all shards (shard, level, hashes, bits), and the number of shards. ``universe``: distinct keys h1, h2, listed."""
    shards = 1 + universe.count() // keys_a_shard
    sharded = universe.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))

    def of_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        levels = build(rows["h1"].to_numpy().astype(np.int64).view(U64), rows["h2"].to_numpy().astype(np.int64).view(U64), rows["listed"].to_numpy(bool))
        return pd.DataFrame([(key[0], i, k, bits) for i, (k, bits) in enumerate(levels)], columns=["shard", "level", "hashes", "bits"])

    return stored(sharded.groupBy("shard").applyInPandas(of_shard, "shard long, level int, hashes int, bits binary"), "cascade"), shards


class Group:
    """The cascades of some shards, level by level: where each shard's bits begin, how many there are, how many hashes ask."""

    def __init__(self, rows: list, first: int, last: int):
        self.first, self.last, deep = first, last, 1 + max([-1, *(r.level for r in rows)])
        many = last - first
        self.at, self.bits, self.hashes = (np.zeros((deep, many), np.int64) for _ in range(3))
        self.depth = np.zeros(many, np.int64)
        begin, parts = 0, []
        for r in rows:
            s = r.shard - first
            self.at[r.level, s], self.bits[r.level, s], self.hashes[r.level, s] = begin, 8 * len(r.bits), r.hashes
            self.depth[s] = max(self.depth[s], r.level + 1)
            parts.append(np.frombuffer(r.bits, np.uint8))
            begin += len(r.bits)
        self.filled = np.concatenate([*parts, np.zeros(1, np.uint8)])

    def answer(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key, of a shard of this group, is listed."""
        s = shard - self.first
        out, todo = self.depth[s] % 2 == 1, np.arange(len(s))  # what passes all levels is in the last filter, and truly
        for level in range(len(self.at)):
            todo = todo[self.depth[s[todo]] > level]
            if not len(todo):
                break
            own = s[todo]
            bits, begin, hashes, inside = self.bits[level, own].astype(U64), self.at[level, own], self.hashes[level, own], np.ones(len(todo), bool)
            for j in range(int(hashes.max())):
                at = _positions(h1[todo], h2[todo], level, j, bits)
                inside &= (self.filled[begin + (at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1).astype(bool) | (hashes <= j)
            out[todo[~inside]] = level % 2 == 1
            todo = todo[inside]
        return out


def _groups(cascades: DataFrame, shards: int, limit_bytes: int) -> list[tuple[int, int]]:
    """Ranges of shards with up to ``limit_bytes`` of filters each, or one shard. The sizes are summed over runs of shards, 10,000 at most."""
    run = 1 + shards // 10_000
    sizes = {r.run: r.n for r in cascades.groupBy((F.col("shard") / run).cast("long").alias("run")).agg(F.sum(F.octet_length("bits")).alias("n")).collect()}
    out, first, total = [], 0, 0
    for i in range(-(-shards // run)):
        n = sizes.get(i, 0)
        if total and total + n > limit_bytes:
            out.append((first, i * run))
            first, total = i * run, 0
        total += n
    return [*out, (first, shards)]


def member(asked: DataFrame, keys_col: str, universe: DataFrame, keys_a_shard: int = 200_000, limit_bytes: int = 32 << 20) -> DataFrame:
    """asked with ``found``, an array that says of each struct (h1, h2) in ``keys_col`` whether it is listed.

    ``universe`` has every distinct key that is asked for, as h1, h2 and listed.
    """
    cascades, shards = _cascades(universe, keys_a_shard)
    spark, groups = asked.sparkSession, _groups(cascades, shards, limit_bytes)
    schema = StructType([*asked.schema.fields, StructField("found", ArrayType(BooleanType()))])
    for i, (first, last) in enumerate(groups):
        held = spark.sparkContext.broadcast(Group(cascades.where(F.col("shard").between(first, last - 1)).collect(), first, last))  # limit_bytes at most
        names = [*asked.columns[: len(schema) - 1], "found"]

        def run(batches: Iterator[pa.RecordBatch], held=held, names=names) -> Iterator[pa.RecordBatch]:
            group = held.value
            for batch in batches:
                lists = batch.column(keys_col)
                flat = lists.flatten()
                h1, h2 = (np.asarray(flat.field(c)).view(U64) for c in ("h1", "h2"))
                shard = np.asarray(flat.field("h1")) % shards
                found = np.asarray(batch.column("found").flatten()).astype(bool) if "found" in batch.schema.names else np.zeros(len(h1), bool)
                mine = (shard >= group.first) & (shard < group.last)
                found = found.copy()
                found[mine] = group.answer(shard[mine], h1[mine], h2[mine])
                ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found))], names)

        asked = asked.mapInArrow(run, schema)
        if i + 1 < len(groups):
            asked = cut(asked)
    return asked


# rules and listed hosts


def _split(rule: Column) -> tuple[Column, Column]:
    """Host and path of a rule ``host/path``."""
    at = F.instr(rule, "/")
    return F.translate(F.substr(rule, F.lit(1), at - 1), UPPER, LOWER), F.substr(rule, at)


def _tagged(tag: str, key: Column) -> Column:
    """The hashes of a key under a tag."""
    return F.struct(F.xxhash64(F.lit(tag), key).alias("h1"), F.xxhash64(key, F.lit(tag), F.lit(1)).alias("h2"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url", keep: Sequence[str] | None = None, keys_a_shard: int = 200_000, limit_bytes: int = 32 << 20) -> DataFrame:
    """``row`` (columns ``keep``, all by default), ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    rules: columns ``rule`` (``host/path``) and ``verdict`` (allow or block); listed: a column ``host``. The shapes of rules (labels of the host,
    length of the path) are gathered, their number is bounded by the longest host and path.
    """
    keep = list(pages.columns if keep is None else keep)
    host, path = host_and_path(F.col("text"))
    sent = pages.select(beside_text(pages, keep, url_col), F.col(f"`{url_col}`").cast("string").alias("text")).withColumns({"host": host, "path": path})
    rule_host, rule_path = _split(F.col("rule"))
    told = rules.where(F.col("rule").contains("/")).select(F.concat(rule_host, rule_path).alias("rule"), (F.col("verdict") == "block").alias("block"), F.size(F.split(rule_host, r"\.")).alias("labels"), F.length(rule_path).alias("length"))
    shapes = sorted((r.labels, r.length) for r in told.select("labels", "length").distinct().collect())
    options = F.array(*(F.when(F.length("path") >= p, F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, p))) for n, p in shapes)) if shapes else F.array().cast("array<string>")
    sent = sent.withColumn("options", F.array_distinct(F.array_compact(options)))
    hashed = lambda tag: F.transform("options", lambda c: _tagged(tag, c))
    sent = sent.withColumn("keys", F.concat(hashed(RULE), hashed(BLOCKING), F.array(_tagged(LISTED, F.col("host")))))
    key = lambda tag, c: _tagged(tag, F.col(c)).alias("k")
    lists = told.select(key(RULE, "rule")).union(told.where("block").select(key(BLOCKING, "rule"))).union(listed.where(F.col("host").isNotNull()).select(key(LISTED, "host")))
    universe = (
        sent.select(F.explode("keys").alias("k"), F.lit(False).alias("listed")).union(lists.select("k", F.lit(True)))
        .groupBy(F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2")).agg(F.max("listed").alias("listed"), F.min("listed").alias("unasked")).where(~F.col("unasked")).select("h1", "h2", "listed")
    )
    found = member(small_batches(sent), "keys", stored(universe, "keys"), keys_a_shard, limit_bytes)
    many = F.size("options")
    fits = F.transform(F.filter(F.arrays_zip(F.col("options").alias("rule"), F.slice("found", 1, many).alias("is"), F.slice("found", many + 1, many).alias("block")), lambda z: z["is"]), lambda z: F.struct(F.length(z["rule"]).alias("n"), F.instr(z["rule"], "/").alias("host"), z["block"].alias("block"), z["rule"].alias("rule")))
    best = F.array_max(fits)
    blocked = F.when(best.isNull(), F.element_at("found", -1)).otherwise(best["block"])
    return found.select(whole_row(pages, keep, url_col), "host", "path", best["rule"].alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


#: The rules of the registered query, and what gives a host away that its list should have.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SUSPECT = r"(^|[.-])(spam|pills|casino|viagra|porn|xxx|poker|betting|malware|phishing|warez)([.-]|$)"


def suspect_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Distinct hosts of the corpus with a suspect word between dots and hyphens: a list for want of an outside one."""
    return pages.select(host_and_path(F.col(f"`{url_col}`"))[0].alias("host")).where(F.col("host").rlike(SUSPECT)).distinct()


SQL = rf"""
WITH parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{r}')" for v, r in RULES)}) t(verdict, rule)),
fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM split JOIN rules ON starts_with(path, substr(rule, instr(rule, '/'))) AND ends_with('.' || host, '.' || substr(rule, 1, instr(rule, '/') - 1))
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{SUSPECT}') THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""
