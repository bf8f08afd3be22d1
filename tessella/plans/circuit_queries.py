"""Hosts' circuits over the events: users stand for hosts, kinds of events for addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import circuits
from tessella.sources.storage import table

from .registry import query

_DAY = 86_400_000_000
CIRCUITS = f"""WITH rq AS (SELECT user_id, {{t: epoch_us(ts), url: event_type || CAST(CAST(floor(value / 25) AS INT) AS VARCHAR), ok: event_type IN ('purchase', 'click')}} AS r FROM events),
ls AS (SELECT user_id, list_sort(list(r)) AS rs FROM rq GROUP BY user_id),
st AS (SELECT user_id, list_prepend({{t: CAST(0 AS BIGINT), url: '', ok: true, failing: CAST([] AS VARCHAR[]), til: CAST(-1 AS BIGINT), lvl: 0, said: CAST([] AS VARCHAR[])}},
list_transform(rs, lambda x: {{t: x.t, url: x.url, ok: x.ok, failing: CAST([] AS VARCHAR[]), til: CAST(-1 AS BIGINT), lvl: 0, said: CAST([] AS VARCHAR[])}})) AS xs FROM ls),
nx AS (SELECT user_id, list_reduce(xs, lambda a, x: {{t: x.t, url: x.url, ok: x.ok,
failing: CASE WHEN a.til >= 0 THEN CASE WHEN x.t < a.til THEN a.failing ELSE CAST([] AS VARCHAR[]) END WHEN x.ok THEN CAST([] AS VARCHAR[]) WHEN list_contains(a.failing, x.url) THEN a.failing WHEN len(a.failing) >= 2 THEN CAST([] AS VARCHAR[]) ELSE list_append(a.failing, x.url) END,
til: CASE WHEN a.til >= 0 THEN CASE WHEN x.t < a.til THEN a.til WHEN x.ok THEN -1 ELSE x.t + {3 * _DAY} END WHEN NOT x.ok AND NOT list_contains(a.failing, x.url) AND len(a.failing) >= 2 THEN x.t + {_DAY} ELSE -1 END,
lvl: CASE WHEN a.til >= 0 THEN CASE WHEN x.t < a.til THEN a.lvl WHEN x.ok THEN 0 ELSE 1 END WHEN NOT x.ok AND NOT list_contains(a.failing, x.url) AND len(a.failing) >= 2 THEN 0 ELSE a.lvl END,
said: list_append(a.said, x.t || ' ' || x.url || ' ' || CASE WHEN a.til < 0 THEN 'sent' WHEN x.t < a.til THEN 'refused' ELSE 'probe' END)}}).said AS said FROM st)"""


@query(f"{CIRCUITS}, u AS (SELECT CAST(user_id AS VARCHAR) AS host, unnest(said) AS s FROM nx) SELECT host, CAST(split_part(s, ' ', 1) AS BIGINT) AS at, split_part(s, ' ', 2) AS url, split_part(s, ' ', 3) AS decision FROM u")
def host_circuit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and clicks are answers, other kinds failures."""
    e = table(spark, sf, "events")
    url = F.concat("event_type", F.floor(F.col("value") / 25).cast("int").cast("string"))
    rows = e.select(F.col("user_id").cast("string").alias("host"), "ts", url.alias("url"), F.col("event_type").isin("purchase", "click").alias("ok"))
    out = circuits.decisions(rows, "host", "ts", "url", "ok", circuits.Rule(3, (_DAY, 3 * _DAY)))
    return out.select("host", "at", "url", "decision")
