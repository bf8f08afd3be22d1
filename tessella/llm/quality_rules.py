"""Quality rules by weak supervision.

Each rule votes good (1) or bad (0) or abstains (null). Expectation-maximisation over the
vote patterns estimates how accurate each rule is, with no labels, and the posterior
probability of quality decides, in place of a filter that every rule must pass.

Text statistics are taken in one vectorised pass; votes, patterns and posteriors are
DataFrame work. There are at most ``3 ** len(RULES)`` patterns whatever the input's size,
so the pattern counts are what comes to the driver.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
repeated rows are scored each on its own; columns beyond ``doc_id`` and ``text`` are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .common import cut, small_batches

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_distinct", "n_wordless", "n_stutters")
_IN = w.SPACE.copy()
_SYMBOL, _UPPER, _LETTER, _BANG = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC0:] = True
_BANG[list(b"!?")] = True


def _count(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[starts[1:]] - sums[starts[:-1]]


def _stats(texts: pa.Array, window: int) -> dict[str, np.ndarray]:
    data, starts = w.text_bytes(texts)
    docs = len(starts) - 1
    runs = w.Runs(data, starts, fold=w.SAME)
    lines = w.Runs(data, starts, w.NEWLINE, w.SAME)
    inside = np.concatenate(([0], np.cumsum(~w.SPACE[data], dtype=np.int64)))
    worded = inside[lines.ends] > inside[lines.starts]
    line_doc, line_hash = lines.doc[worded], lines.hash[worded]
    _, again = w.repeated(line_doc, line_hash)
    keys, at = w.windows(runs.hash, runs.doc, window)
    twice, _ = w.repeated(runs.doc[at], keys)
    cover = np.zeros(len(runs.hash) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    stutter = (runs.hash[1:] == runs.hash[:-1]) & (runs.doc[1:] == runs.doc[:-1])
    letters = np.concatenate(([0], np.cumsum(_LETTER[data], dtype=np.int64)))
    _, seen = w.repeated(runs.doc, runs.hash)
    return {
        "n_words": w.per_doc(runs.doc, docs),
        "word_chars": _count(~w.SPACE[data] & ~w.CONTINUATION[data], starts),
        "n_symbols": _count(_SYMBOL[data], starts),
        "n_dup_lines": w.per_doc(line_doc[again], docs),
        "n_repeat_words": w.per_doc(runs.doc[covered], docs),
        "n_lines": w.per_doc(line_doc, docs),
        "n_upper": _count(_UPPER[data], starts),
        "n_letters": _count(_LETTER[data], starts),
        "n_bangs": _count(_BANG[data], starts),
        "n_distinct": w.per_doc(runs.doc[~seen], docs),
        "n_wordless": w.per_doc(runs.doc[letters[runs.ends] == letters[runs.starts]], docs),
        "n_stutters": w.per_doc(runs.doc[1:][stutter], docs),
    }


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """The id and ``STATS`` (long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in w.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, _stats(part.column("text"), window).values())], ["id", *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in STATS))
    return out.withColumnRenamed("id", id_col)


def _rule(bad: Column, good: Column, applies: Column | None = None) -> Column:
    vote = F.when(bad, 0).when(good, 1)
    return vote if applies is None else F.when(applies, vote)


def rules() -> dict[str, Column]:
    """Votes by name, over the columns of ``text_stats``; extend or replace to taste."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    length, upper = per_word("word_chars"), F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    long_enough = F.col("n_words") >= 20
    return {
        "word_length": _rule((length < 2.5) | (length > 12), length.between(3.0, 10.0)),
        "symbols": _rule(per_word("n_symbols") > 0.15, per_word("n_symbols") < 0.03),
        "shouting": _rule(upper > 0.5, upper < 0.2),
        "repeated_lines": _rule(dup > 0.3, dup < 0.05, F.col("n_lines") >= 3),
        "repeated_words": _rule(per_word("n_repeat_words") > 0.2, per_word("n_repeat_words") < 0.05, long_enough),
        "exclamations": _rule(per_word("n_bangs") > 0.2, per_word("n_bangs") < 0.05),
        "letters": _rule(F.col("n_letters") < 0.72 * F.col("word_chars"), F.col("n_letters") > 0.8 * F.col("word_chars")),
        "wordless": _rule(per_word("n_wordless") > 0.2, per_word("n_wordless") < 0.1),
        "stutter": _rule(per_word("n_stutters") > 0.2, per_word("n_stutters") < 0.05, long_enough),
        "variety": _rule(per_word("n_distinct") < 0.12, per_word("n_distinct") > 0.25, long_enough),
    }


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 500, share: float = 0.8, alarm: float = 0.01, caught: float = 0.25) -> tuple[float, list[tuple[float, float]], dict]:
    """Expectation-maximisation over (votes, count) pairs.

    A rule has two rates, both over the documents on which it votes: how often it votes bad on good ones and on
    bad ones. EM climbs to the maximum of the likelihood next to its start, which says what is meant by the two classes:
    most documents are good, rules seldom raise a false alarm and each catches some of the bad ones. A rule that would vote bad
    more often on good documents than on bad ones tells nothing: it gets the same rate for both. One document a class
    at the start's rates keeps rates off 0 and 1; it doesn't grow with the counts.
    Returns the share of good documents, each rule's two rates, each pattern's posterior.
    """
    rules_n = len(patterns[0][0]) if patterns else 0
    rates = [(alarm, caught)] * rules_n
    posterior: dict = {}
    for _ in range(rounds):
        bad, seen = [[0.0, 0.0] for _ in range(rules_n)], [[0.0, 0.0] for _ in range(rules_n)]
        good = total = 0.0
        for votes, n in patterns:
            odds = math.log(share / (1 - share))
            for v, (a, c) in zip(votes, rates, strict=True):
                if v is not None:
                    odds += math.log((1 - a) / (1 - c)) if v else math.log(a / c)
            p = posterior[votes] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            good, total = good + n * p, total + n
            for j, v in enumerate(votes):
                if v is not None:
                    for k, q in enumerate((p, 1 - p)):
                        bad[j][k] += n * q * (1 - v)
                        seen[j][k] += n * q
        fresh = []
        for (b_good, b_bad), (n_good, n_bad) in zip(bad, seen, strict=True):
            a, c = (b_good + alarm) / (n_good + 1), (b_bad + caught) / (n_bad + 1)
            if c < a:
                a = c = (b_good + b_bad + alarm) / (n_good + n_bad + 1)
            fresh.append((min(max(a, 1e-5), 1 - 1e-5), min(max(c, 1e-5), 1 - 1e-5)))
        now = min(1 - 1e-4, max(1e-4, good / total)) if total else share
        moved = max([abs(now - share), *(abs(x - y) for p, q in zip(fresh, rates, strict=True) for x, y in zip(p, q, strict=True))])
        share, rates = now, fresh
        if moved < 1e-7:
            break
    return share, rates, posterior


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", votes: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """The id, ``STATS``, ``base_failed``, ``p_good`` (the posterior) and ``kept``."""
    votes = votes or rules()
    names = list(votes)
    stats = cut(text_stats(small_batches(docs), id_col, text_col).withColumns({f"vote_{k}": v for k, v in votes.items()}))
    columns = [f"vote_{k}" for k in names]
    found = stats.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    _, _, posterior = estimate(sorted(((tuple(r[c] for c in columns), r["n"]) for r in found), key=str))
    key = F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    known = {"".join("-" if v is None else str(v) for v in k): p for k, p in posterior.items()}
    table = docs.sparkSession.createDataFrame(list(known.items()), "votes string, p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("votes", key).join(F.broadcast(table), "votes")
    return out.select(id_col, *STATS, failed.alias("base_failed"), "p_good", (~failed & (F.col("p_good") >= threshold)).alias("kept"))
