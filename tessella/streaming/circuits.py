"""Hosts' circuits over a stream of requests, with the same steps as over a table.

Requests wait in a host's state until the watermark has passed their time, when a timer takes them in order; so decisions don't depend on the order or the batches in which requests
arrive within it. Needs the RocksDB state store, which ``STORE`` names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.circuits import COLUMNS, Circuit, Rule

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Circuits(StatefulProcessor):
    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.circuit = handle.getValueState("circuit", "failing array<string>, open_until long, level int")
        self.waiting = handle.getMapState("waiting", "ms long", "requests array<struct<at:long,url:string,ok:boolean>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new: dict[int, list[tuple]] = {}
        for batch in rows:
            for r in batch.itertuples(index=False):
                new.setdefault(int(r.at) // 1000, []).append((int(r.at), r.url, bool(r.ok)))
        for ms, requests in new.items():
            there = list(self.waiting.getValue((ms,))[0]) if self.waiting.containsKey((ms,)) else []
            self.waiting.updateValue((ms,), ([tuple(x) for x in there] + requests,))
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((ms,)):
            return
        requests = sorted(tuple(x) for x in self.waiting.getValue((ms,))[0])
        self.waiting.removeKey((ms,))
        held = self.circuit.get() if self.circuit.exists() else ([], -1, 0)
        circuit, out = Circuit(list(held[0]), held[1], held[2]), []
        for at, url, ok in requests:
            out.append((key[0], at, url, ok, circuit.step(self.rule, at, url, ok), circuit.open_until, circuit.level))
        self.circuit.update((circuit.failing, circuit.open_until, circuit.level))
        yield pd.DataFrame(out, columns=["host", "at", "url", "ok", "decision", "open_until", "level"])

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, host: str, ts: str, url: str, ok: str, rule: Rule = Rule(), late: str = "1 minute") -> DataFrame:
    """What ``operators.circuits.decisions`` gives, for each request once the watermark has passed it; later ones than ``late`` are dropped."""
    rows = stream.withWatermark(ts, late).dropna(subset=[host, ts])
    rows = rows.select(F.col(host).cast("string").alias("host"), F.col(ts), F.unix_micros(F.col(ts)).alias("at"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    return rows.groupBy("host").transformWithStateInPandas(statefulProcessor=_Circuits(rule), outputStructType=COLUMNS, outputMode="Append", timeMode="EventTime")
