"""Calendars over the driver's tables: a supplier's month is an event, its lines with a low tax published sessions, the others proposed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.operators import calendars
from tessella.sources.storage import parts_for, table

from .registry import query

TODAY = "1998-06-01"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_tax", "l_discount", "l_returnflag", "l_quantity", F.to_date("l_shipdate").alias("day"))
    time = F.when(F.col("l_returnflag") != "N", F.when(F.col("l_quantity") > 25, "20:00").otherwise("18:00"))
    return li.select((F.col("l_suppkey") * 1000 + (F.year("day") - 1995) * 12 + F.month("day")).alias("k"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("ident"), F.to_date(F.date_trunc("week", "day")).alias("date"), time.alias("time"), "l_tax", "l_discount", "l_suppkey", "day")


LINES = """WITH li AS (SELECT l_suppkey * 1000 + (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ident, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_quantity > 25 THEN '20:00' ELSE '18:00' END END AS time, l_tax, l_discount, l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem),
p AS (SELECT DISTINCT k, ident, date, time, coalesce(time, '') AS t FROM li WHERE l_tax < 0.03), n AS (SELECT DISTINCT k, date, time, coalesce(time, '') AS t FROM li WHERE l_tax >= 0.06)"""


@query(f"""{LINES}, c0 AS (SELECT DISTINCT k, date AS fd, time AS ft, date + 7 AS td, CASE WHEN l_discount = 0.1 THEN time ELSE '20:00' END AS tt FROM li WHERE l_tax < 0.03 AND l_discount >= 0.09),
c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fd, ft NULLS FIRST, td, tt NULLS FIRST) AS o FROM c0),
sc AS (SELECT DISTINCT k, CAST(date_trunc('month', day) AS DATE) AS a, CAST(date_trunc('month', day) AS DATE) + 12 AS b FROM li JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 5000),
cc AS (SELECT c.*, EXISTS (SELECT 1 FROM c x WHERE x.k = c.k AND x.o <> c.o AND ((x.fd = c.fd AND (x.ft IS NULL OR c.ft IS NULL OR x.ft = c.ft)) OR (x.td = c.td AND x.tt IS NOT DISTINCT FROM c.tt))) AS clash,
(SELECT count(*) FROM p WHERE p.k = c.k AND p.date = c.fd AND (c.ft IS NULL OR p.time = c.ft)) AS own,
(SELECT count(*) FROM p WHERE p.k = c.k AND p.date = c.td AND p.time IS NOT DISTINCT FROM c.tt AND NOT EXISTS (SELECT 1 FROM c x WHERE x.k = p.k AND x.fd = p.date AND (x.ft IS NULL OR x.ft = p.time) AND (x.o = c.o OR (x.o < c.o AND x.fd >= DATE '{TODAY}')))) AS there,
(SELECT count(*) FROM n WHERE n.k = c.k AND n.date = c.td AND n.time IS NOT DISTINCT FROM c.tt) AS wanted FROM c),
cs AS (SELECT *, clash OR CASE WHEN fd < DATE '{TODAY}' THEN own = 0 AND ((there <> 1 AND wanted <> 1) OR there > 1)
WHEN own > 1 OR there > 1 THEN true WHEN own = 0 THEN NOT (there = 1 OR (td >= DATE '{TODAY}' AND wanted = 1)) ELSE wanted <> 1 OR there = 1 END AS odd FROM cc),
mv AS (SELECT cs.k, p.ident, td, tt FROM cs JOIN p ON p.k = cs.k AND p.date = cs.fd AND (cs.ft IS NULL OR p.time = cs.ft) WHERE NOT odd AND own = 1 AND fd >= DATE '{TODAY}'),
p1 AS (SELECT *, row_number() OVER (PARTITION BY k, date, t ORDER BY ident) AS r FROM p WHERE (k, ident) NOT IN (SELECT (k, ident) FROM mv)), n1 AS (SELECT * FROM n WHERE (k, date, t) NOT IN (SELECT (k, td, coalesce(tt, '')) FROM mv)),
ex AS (SELECT p1.k, p1.ident, p1.date, p1.t FROM p1 JOIN n1 USING (k, date, t) WHERE r = 1),
p2 AS (SELECT p1.*, coalesce(p1.date BETWEEN a AND b, false) AS scope FROM p1 LEFT JOIN sc USING (k) WHERE (p1.k, p1.ident) NOT IN (SELECT (k, ident) FROM ex)),
n2 AS (SELECT n1.*, coalesce(n1.date BETWEEN a AND b, false) AS scope FROM n1 LEFT JOIN sc USING (k) WHERE (n1.k, n1.date, n1.t) NOT IN (SELECT (k, date, t) FROM ex)),
able AS (SELECT k, date, count(*) AS cand, min(ident) AS ident FROM p2 WHERE date >= DATE '{TODAY}' AND (scope OR time IS NULL) GROUP BY ALL), un AS (SELECT k, date, count(*) AS un FROM n2 GROUP BY ALL),
n3 AS (SELECT n2.*, coalesce(cand, 0) AS cand, un, able.ident FROM n2 JOIN un USING (k, date) LEFT JOIN able USING (k, date)),
rv AS (SELECT DISTINCT k FROM cs WHERE odd UNION SELECT k FROM n3 WHERE cand > 0 AND (cand <> 1 OR un <> 1)),
tm AS (SELECT k, ident, date, time FROM n3 WHERE cand = 1 AND un = 1 AND (scope OR time IS NOT NULL)),
stay AS (SELECT p.k, p.ident, CASE WHEN rv.k IS NULL THEN coalesce(mv.td, p.date) ELSE p.date END AS date, CASE WHEN rv.k IS NOT NULL THEN p.time WHEN mv.k IS NOT NULL THEN mv.tt WHEN tm.k IS NOT NULL THEN tm.time ELSE p.time END AS time,
CASE WHEN rv.k IS NOT NULL THEN 'review' WHEN mv.k IS NOT NULL THEN 'moved' WHEN ex.k IS NOT NULL THEN 'kept' WHEN tm.k IS NOT NULL THEN 'timed' WHEN p.date >= DATE '{TODAY}' AND coalesce(p.date BETWEEN sc.a AND sc.b, false) THEN 'dropped' ELSE 'kept' END AS action, CAST(NULL AS BIGINT) AS place
FROM p LEFT JOIN rv USING (k) LEFT JOIN mv ON mv.k = p.k AND mv.ident = p.ident LEFT JOIN ex ON ex.k = p.k AND ex.ident = p.ident LEFT JOIN tm ON tm.k = p.k AND tm.ident = p.ident LEFT JOIN sc ON sc.k = p.k),
fr AS (SELECT k, NULL AS ident, date, time, 'new' AS action, coalesce((SELECT count(*) FROM p WHERE p.k = n3.k), 0) + row_number() OVER (PARTITION BY k ORDER BY date, t) AS place FROM n3 WHERE (k, date, t) NOT IN (SELECT (k, date, coalesce(time, '')) FROM tm) AND k NOT IN (SELECT k FROM rv))
SELECT k, ident, strftime(date, '%Y-%m-%d') AS date, time, action, place FROM (SELECT * FROM stay UNION ALL SELECT * FROM fr)""")
def calendar_with_times(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    old = li.where("l_tax < 0.03")
    published, proposed = old.select("k", "ident", "date", "time").distinct(), li.where("l_tax >= 0.06").select("k", "date", "time")
    moves = old.where("l_discount >= 0.09").select("k", F.col("date").alias("from_date"), F.col("time").alias("from_time"), F.date_add("date", 7).alias("to_date"), F.when(F.col("l_discount") == 0.1, F.col("time")).otherwise("20:00").alias("to_time")).distinct()
    order = Window.partitionBy("k").orderBy("from_date", F.col("from_time").asc_nulls_first(), "to_date", F.col("to_time").asc_nulls_first())
    month = F.to_date(F.date_trunc("month", "day"))
    scopes = li.join(table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey").select("k", month.alias("first"), F.date_add(month, 12).alias("last")).distinct()
    out = calendars.planned(published, proposed, moves.withColumn("order", F.row_number().over(order)), scopes, "k", "ident", TODAY, parts_for(table(spark, sf, "lineitem")))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query(f"""{LINES}, ps AS (SELECT k, ident, date, time FROM p), st AS (SELECT k, CASE WHEN max(l_discount) < 0.07 THEN 'postponed' ELSE 'scheduled' END AS was, CASE WHEN min(l_tax) > 0.01 THEN 'cancelled' WHEN min(l_discount) > 0.01 THEN 'postponed' ELSE 'scheduled' END AS now FROM li GROUP BY k),
pk AS (SELECT k, count(*) AS c, min(ident) AS ident FROM p GROUP BY k), nk AS (SELECT k, count(*) AS c, min(date) AS date, min(time) AS time FROM n GROUP BY k),
mv AS (SELECT st.k, pk.ident, nk.date, nk.time FROM st JOIN pk USING (k) JOIN nk USING (k) WHERE pk.c = 1 AND nk.c = 1 AND 'postponed' IN (was, now)),
p1 AS (SELECT * FROM ps WHERE k NOT IN (SELECT k FROM mv)), n1 AS (SELECT * FROM n WHERE k NOT IN (SELECT k FROM mv)),
pd AS (SELECT k, date, count(*) AS pn, min(time) AS pt FROM p1 GROUP BY ALL), nd AS (SELECT k, date, count(*) AS nn, min(time) AS nt FROM n1 GROUP BY ALL),
rows AS (SELECT k, ident, date, time, 'moved' AS change FROM mv
UNION ALL SELECT p1.k, ident, p1.date, p1.time, CASE WHEN n1.k IS NULL THEN 'kept' ELSE 'exact' END FROM p1 LEFT JOIN n1 ON n1.k = p1.k AND n1.date = p1.date AND n1.time = p1.time WHERE p1.time IS NOT NULL
UNION ALL SELECT p1.k, ident, p1.date, CASE WHEN pn = 1 AND nn = 1 THEN nt END, CASE WHEN pn = 1 AND nn = 1 AND nt IS NOT NULL THEN 'refined' WHEN pn = 1 AND nn = 1 THEN 'exact' ELSE 'kept' END FROM p1 JOIN pd USING (k, date) LEFT JOIN nd USING (k, date) WHERE p1.time IS NULL
UNION ALL SELECT n1.k, NULL, n1.date, n1.time, 'new' FROM n1 LEFT JOIN pd USING (k, date) JOIN nd USING (k, date) WHERE NOT EXISTS (SELECT 1 FROM p1 WHERE p1.k = n1.k AND p1.date = n1.date AND p1.time = n1.time) AND NOT coalesce(pn = 1 AND nn = 1 AND (pt IS NULL OR n1.time IS NULL), false))
SELECT k, ident, strftime(date, '%Y-%m-%d') AS date, time, change, CASE WHEN now = 'cancelled' AND change <> 'new' THEN 'cancelled' ELSE 'scheduled' END AS status FROM rows JOIN st USING (k)""")
def postponement_merge(spark: SparkSession, sf: str) -> DataFrame:
    li = _lines(spark, sf)
    was = F.when(F.max("l_discount") < 0.07, "postponed").otherwise("scheduled")
    now = F.when(F.min("l_tax") > 0.01, "cancelled").when(F.min("l_discount") > 0.01, "postponed").otherwise("scheduled")
    status = li.groupBy("k").agg(was.alias("was"), now.alias("now"))
    out = calendars.merged(li.where("l_tax < 0.03").select("k", "ident", "date", "time"), li.where("l_tax >= 0.06").select("k", "date", "time"), status, "k", "ident", parts_for(table(spark, sf, "lineitem")))
    return out.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
