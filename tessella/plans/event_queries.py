"""Run accounting and event logic over ``events``: types stand for what became of an observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import civil
from tessella.operators import accounting, events
from tessella.sources.storage import table

from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    kind, hour = F.col("event_type"), F.hour("ts")
    action = F.when((kind == "error") & (hour < 12), "ambiguous").when(kind == "purchase", "new").when(kind == "signup", "updated").when((kind == "click") & (hour < 8), "unchanged")
    skip = F.when((kind == "click") & (hour < 16), "cancelado").when(kind == "click", "fuera de ventana")
    eligibility = F.when((kind == "view") & (hour < 12), "exclude").when(kind == "view", "uncertain")
    return _events(spark, sf).select("user_id", "event_id", accounting.outcome(action, skip, eligibility).alias("outcome"))


DECIDED = """(SELECT user_id, event_id, CASE WHEN event_type = 'error' AND hour(ts) < 12 THEN 'ambiguous' WHEN event_type = 'purchase' THEN 'created' WHEN event_type = 'signup' THEN 'updated' WHEN event_type = 'click' AND hour(ts) < 8 THEN 'unchanged'
WHEN event_type = 'click' AND hour(ts) < 16 THEN 'cancelled-not-created' WHEN event_type = 'click' THEN 'structural-skip' WHEN event_type = 'view' AND hour(ts) < 12 THEN 'excluded' WHEN event_type = 'view' THEN 'uncertain' ELSE 'structural-skip' END AS outcome FROM events)"""
FUNNEL = "SELECT user_id, count(*) AS observations, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o.replace('-', '_')}" for o in accounting.OUTCOMES) + f" FROM {DECIDED} GROUP BY user_id"


@query(f"SELECT outcome, count(*) AS n FROM {DECIDED} GROUP BY outcome")
def outcome_tally(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.tally(_decisions(spark, sf), "outcome")


@query(FUNNEL)
def source_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.funnel(_decisions(spark, sf), "user_id")


@query(f"SELECT CAST(sum(observations) AS BIGINT) AS observations, CAST(sum({' + '.join(o.replace('-', '_') for o in accounting.OUTCOMES)}) AS BIGINT) AS outcomes, CAST(0 AS BIGINT) AS broken FROM ({FUNNEL})")
def accounting_holds(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.holds(accounting.funnel(_decisions(spark, sf), "user_id"))


@query(f"""SELECT user_id, CASE WHEN created = 0 THEN 'fatal' WHEN ambiguous > 5 THEN 'review' WHEN uncertain > 10 OR excluded > 10 THEN 'degraded' ELSE 'clean' END AS health,
concat_ws(',', CASE WHEN created = 0 THEN 'no-sources-succeeded' END, CASE WHEN ambiguous > 5 THEN 'ambiguous' END, CASE WHEN uncertain > 10 THEN 'ai-uncertain' END, CASE WHEN excluded > 10 THEN 'possibly-missing' END) AS reasons,
NOT (created = 0 OR ambiguous > 5) AS auto_merge FROM ({FUNNEL})""")
def health_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    findings = {"no-sources-succeeded": (c("created") == 0, "fatal"), "ambiguous": (c("ambiguous") > 5, "review"), "ai-uncertain": (c("uncertain") > 10, "degraded"), "possibly-missing": (c("excluded") > 10, "degraded")}
    return accounting.health(accounting.funnel(_decisions(spark, sf), "user_id"), "user_id", findings)


@query(f"SELECT user_id, ambiguous, row_number() OVER (ORDER BY ambiguous DESC, structural_skip DESC, user_id) AS place FROM ({FUNNEL}) WHERE ambiguous > 0")
def attention_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = accounting.funnel(_decisions(spark, sf), "user_id").where("ambiguous > 0")
    return accounting.ranked(rows, F.desc("ambiguous"), F.desc("structural_skip"), F.asc("user_id")).select("user_id", "ambiguous", "place")


def _tried() -> tuple[Column, Column]:
    return F.col("event_type").isin("click", "error"), F.col("event_type") == "click"


@query("""SELECT user_id, a AS attempted, s AS succeeded, a - s AS failed, a > 0 AND (s = 0 OR (a - s >= 3 AND 2 * (a - s) >= a)) AS severe
FROM (SELECT user_id, count(*) FILTER (event_type IN ('click', 'error')) AS a, count(*) FILTER (event_type = 'click') AS s FROM events GROUP BY user_id)""")
def hydration_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return accounting.hydration(_events(spark, sf), "user_id", *_tried())


@query("""SELECT user_id, CASE WHEN max(CAST(ts AS DATE)) < DATE '2024-01-05' THEN 'stale' WHEN min(CAST(ts AS DATE)) <= DATE '2024-01-05' AND max(CAST(ts AS DATE)) >= DATE '2024-01-28' THEN 'complete' ELSE 'partial' END AS status FROM events GROUP BY user_id""")
def temporal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    spans = _events(spark, sf).groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return spans.select("user_id", accounting.coverage(F.col("a"), F.col("b"), "2024-01-05", "2024-01-28").alias("status"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_latency(spark: SparkSession, sf: str) -> DataFrame:
    out = accounting.quantiles(_events(spark, sf), "event_type", "value", {"p50": 0.5, "p95": 0.95})
    return out.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


ROUTES = "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS good, count(*) FILTER (event_type <> 'error') AS sent FROM events GROUP BY user_id"


@query(f"SELECT user_id, row_number() OVER (ORDER BY n < 60, round(good / nullif(sent, 0), 9) DESC NULLS LAST, round(sent / n, 9) DESC, user_id) AS place FROM ({ROUTES})")
def route_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("good"), F.count_if(F.col("event_type") != "error").alias("sent"))
    order = (F.asc("few"), F.desc_nulls_last("rate"), F.desc("sent_rate"), F.asc("user_id"))
    rated = rows.withColumns({"few": F.col("n") < 60, "rate": F.round(F.try_divide("good", "sent"), 9), "sent_rate": F.round(F.col("sent") / F.col("n"), 9)})
    return accounting.ranked(rated, *order).select("user_id", "place")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS in_minute, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def rate_limit_60s(spark: SparkSession, sf: str) -> DataFrame:
    minute = events.rate(_events(spark, sf), "user_id", "ts", 60).withColumnRenamed("in_window", "in_minute")
    return events.rate(minute, "user_id", "ts", 3600).select("event_id", "user_id", "in_minute", F.col("in_window").alias("in_hour"))


@query("SELECT user_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def daily_quota_zone(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles"), "yyyy-MM-dd")
    return _events(spark, sf).groupBy("user_id", day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT *, event_type IN ('error', 'view') AS bad, count(*) FILTER (event_type NOT IN ('error', 'view')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened_at, count(*) AS length FROM m WHERE bad GROUP BY user_id, run HAVING count(*) >= 4""")
def circuit_breaker(spark: SparkSession, sf: str) -> DataFrame:
    found = events.streaks(_events(spark, sf), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "view"))
    return found.withColumn("opened_at", F.date_format("opened_at", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH g AS (SELECT *, lead(ts) OVER w - ts AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), q AS (SELECT * FROM g WHERE gap IS NULL OR gap >= INTERVAL 15 MINUTE)
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM q) WHERE b IS DISTINCT FROM event_type""")
def debounced_search(spark: SparkSession, sf: str) -> DataFrame:
    return events.debounced(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type", 900).select("event_id", "user_id", "event_type")


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def claim_once(spark: SparkSession, sf: str) -> DataFrame:
    return events.once(_events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, before, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def filter_state_diff(spark: SparkSession, sf: str) -> DataFrame:
    return events.changes(_events(spark, sf), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "before", "event_type")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"))


@query("""WITH m AS (SELECT s_suppkey, list(DISTINCT strftime(l_shipdate, '%Y-%m')) AS have FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey AND l_shipdate >= TIMESTAMP '2001-01-01' GROUP BY s_suppkey)
SELECT s_suppkey, array_to_string(list_filter(['2001-09', '2001-10', '2001-11', '2001-12'], lambda x: NOT coalesce(list_contains(have, x), FALSE)), ',') AS missing FROM m""")
def discovery_coverage(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'2001-01-01'").select(F.col("l_suppkey").alias("s_suppkey"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    have = li.groupBy("s_suppkey").agg(F.collect_set("month").alias("have"))
    wanted = civil.months(F.lit("2001-09-10").cast("date"), F.lit("2001-12-05").cast("date"))
    out = table(spark, sf, "supplier").select("s_suppkey").join(have, "s_suppkey", "left")
    return out.select("s_suppkey", F.array_join(F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>"))), ",").alias("missing"))
