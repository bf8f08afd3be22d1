"""A host's circuit: closed until enough of its addresses fail, open for a time that grows, then one probe decides.

The rule is one step from a state and a request to the next state and a decision; a log in a table and a stream of requests (``tessella.streaming.circuits``) take the same steps, so they agree. A
host's requests are one sequence by their nature: they pass one task in order, which holds a batch of them and the host's state, nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What was decided about a request: it was sent, refused while the circuit was open, or sent as a probe after that.
SENT, REFUSED, PROBE = "sent", "refused", "probe"
COLUMNS = "host string, at long, url string, ok boolean, decision string, open_until long, level int"


@dataclass(frozen=True)
class Rule:
    """So many different addresses fail with no success between them; pauses in microseconds, of which a probe that fails takes the next."""

    least: int = 4
    pauses: Sequence[int] = (10_000_000, 30_000_000)


@dataclass
class Circuit:
    failing: list[str] = field(default_factory=list)
    open_until: int = -1
    level: int = 0

    def step(self, rule: Rule, at: int, url: str, ok: bool) -> str:
        if self.open_until >= 0:
            if at < self.open_until:
                return REFUSED
            if ok:
                self.failing, self.open_until, self.level = [], -1, 0
            else:
                self.level = min(self.level + 1, len(rule.pauses) - 1)
                self.open_until = at + rule.pauses[self.level]
            return PROBE
        if ok:
            self.failing = []
        elif url not in self.failing:
            self.failing = [*self.failing, url]
            if len(self.failing) >= rule.least:
                self.failing, self.open_until, self.level = [], at + rule.pauses[0], 0
        return SENT


def decisions(requests: DataFrame, host: str, ts: str, url: str, ok: str, rule: Rule = Rule()) -> DataFrame:
    """(host, at, url, ok, decision, open_until, level) of every request, as its host's circuit stands when it is made.

    ``at`` and ``open_until`` are microseconds since 1970 (-1: closed). Requests of one host and time are in order of their address, failures first; those without a host or time are left out, a null ``ok`` is a failure.
    """
    rows = requests.select(F.col(host).cast("string").alias("host"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(ok), F.lit(False)).alias("ok")).dropna(subset=["host", "at"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, circuit = None, Circuit()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.host != now:
                    now, circuit = r.host, Circuit()
                out.append((*r, circuit.step(rule, r.at, r.url, bool(r.ok)), circuit.open_until, circuit.level))
            yield pd.DataFrame(out, columns=["host", "at", "url", "ok", "decision", "open_until", "level"])

    return rows.repartition("host").sortWithinPartitions("host", "at", "url", "ok").mapInPandas(run, COLUMNS)


def openings(decided: DataFrame) -> DataFrame:
    """(host, openings, refused, probes, last_open) for each host."""
    opened = (F.col("open_until") >= 0) & (F.col("decision") != REFUSED)
    return decided.groupBy("host").agg(F.count_if(opened).alias("openings"), F.count_if(F.col("decision") == REFUSED).alias("refused"), F.count_if(F.col("decision") == PROBE).alias("probes"), F.max(F.when(opened, F.col("open_until"))).alias("last_open"))
