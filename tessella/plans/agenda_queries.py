"""Agenda queries over the driver's tables: orders are events, line items their occurrences (O: scheduled),
nations venues, regions root venues, suppliers organisers, parts works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import civil, text
from tessella.operators import agenda, export
from tessella.sources.storage import table

from .registry import query

NOW = "2001-06-15 10:00"
NOW_ORDERS = "2001-06-01 10:00"


def _day(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.to_date(column))


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """(c_custkey, venue, root): the customer's nation and region."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    nations = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("venue"), F.col("r_name").alias("root"))  # Spark broadcasts it by its size
    return c.join(nations, c.c_nationkey == nations.n_nationkey).select("c_custkey", "venue", "root")


def _upcoming(spark: SparkSession, sf: str) -> DataFrame:
    li = _day(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus"), "l_shipdate", "day")
    li = li.where((F.col("l_linestatus") == "O") & civil.upcoming(F.col("day"), NOW))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "l_linenumber", "day", "venue", "root", "o_orderpriority")


UPCOMING = """SELECT o_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, n_name AS venue, r_name AS root, o_orderpriority
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= DATE '2001-06-15'"""
ORDERS = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderstatus, o_custkey, o_orderpriority FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-06-01'"


@query(f"SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM ({UPCOMING})")
def agenda_upcoming(spark: SparkSession, sf: str) -> DataFrame:
    return _text(_upcoming(spark, sf), "day")


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = _day(table(spark, sf, "orders"), "o_orderdate", "day")
    return o.where(civil.upcoming(F.col("day"), NOW_ORDERS)).select("o_orderkey", "day", "o_orderstatus", "o_custkey", "o_orderpriority")


@query(f"SELECT o_orderkey, strftime(day, '%Y-%m-%d') AS day FROM (SELECT *, rank() OVER (ORDER BY day) AS place FROM ({ORDERS})) WHERE place <= 150")
def agenda_first_page_ties(spark: SparkSession, sf: str) -> DataFrame:
    return _text(agenda.first_page(_orders(spark, sf), "day").select("o_orderkey", "day"), "day")


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(n) AS BIGINT) AS n FROM (SELECT day, count(*) AS n FROM ({ORDERS}) GROUP BY day UNION ALL SELECT DATE '2001-06-01', 0) GROUP BY day")
def agenda_days(spark: SparkSession, sf: str) -> DataFrame:
    return _text(agenda.with_today(agenda.day_counts(_orders(spark, sf), "day"), "day", NOW_ORDERS[:10]), "day")


@query(f"""WITH d AS (SELECT day, count(*) AS n FROM ({ORDERS}) GROUP BY day), t AS (SELECT day, sum(n) OVER (ORDER BY day) AS total, lead(day) OVER (ORDER BY day) IS NULL AS final FROM d)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(total AS BIGINT) AS total FROM t WHERE NOT final AND total >= 8 ORDER BY total > 12, abs(total - 10), day LIMIT 1""")
def agenda_inline_break(spark: SparkSession, sf: str) -> DataFrame:
    return _text(agenda.inline_break(agenda.day_counts(_orders(spark, sf), "day"), "day"), "day")


@query(f"""SELECT u.o_orderkey, u.l_linenumber, strftime(u.day, '%Y-%m-%d') AS day FROM ({UPCOMING}) u JOIN lineitem l ON l.l_orderkey = u.o_orderkey AND l.l_linenumber = u.l_linenumber JOIN part ON l_partkey = p_partkey
WHERE day BETWEEN DATE '2001-06-15' AND DATE '2001-10-01' AND root = 'EUROPE' AND o_orderpriority = '1-URGENT' AND contains(lower(p_type), 'a')""")
def agenda_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    works = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rows = _upcoming(spark, sf).join(works, ["o_orderkey", "l_linenumber"]).join(table(spark, sf, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    wanted = {"from": "2001-06-15", "to": "2001-10-01", "area": "EUROPE", "kind": "1-URGENT", "q": "a", "access": "", "era": ""}
    have = {"date": F.col("day"), "area": F.col("root"), "kind": F.col("o_orderpriority"), "q": F.col("p_type")}
    return _text(rows.where(agenda.matches(wanted, have)).select("o_orderkey", "l_linenumber", "day"), "day")


FOLD = "trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id FROM documents WHERE contains({FOLD}, 'ein')")
def agenda_search_q(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(text.contains(F.col("text"), "Éin")).select("doc_id")


@query(f"SELECT doc_id, md5({FOLD}) AS folded FROM documents")
def text_fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, strftime(CASE WHEN isodow(d) >= 5 THEN d ELSE d + CAST(5 - isodow(d) AS INTEGER) END, '%Y-%m-%d') AS first, strftime(d + CAST(7 - isodow(d) AS INTEGER), '%Y-%m-%d') AS last
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""")
def weekend_window(spark: SparkSession, sf: str) -> DataFrame:
    days = _day(table(spark, sf, "orders"), "o_orderdate", "day").select("day").distinct()
    first, last = civil.weekend(F.col("day"))
    return _text(days.select("day", first.alias("first"), last.alias("last")), "day", "first", "last")


@query("SELECT strftime(d, '%Y-%m-%d') AS day, strftime(make_date(year(d) + CASE WHEN month(d) >= 8 THEN 1 ELSE 0 END, 7, 31), '%Y-%m-%d') AS until FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)")
def season_window(spark: SparkSession, sf: str) -> DataFrame:
    days = _day(table(spark, sf, "orders"), "o_orderdate", "day").select("day").distinct()
    return _text(days.select("day", civil.season_end(F.col("day")).alias("until")), "day", "until")


@query(f"SELECT DISTINCT root, venue FROM ({UPCOMING})")
def facet_venues(spark: SparkSession, sf: str) -> DataFrame:
    return _upcoming(spark, sf).select("root", "venue").distinct()


@query("""SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, n_name AS venue, r_name AS root, l.n, l.organisers
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT s_name, '; ' ORDER BY s_name) AS organisers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey) l ON l_orderkey = o_orderkey""")
def resolve_events(spark: SparkSession, sf: str) -> DataFrame:
    li, s = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    lists = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), export.joined(F.collect_list("s_name")).alias("organisers"))
    o = _day(table(spark, sf, "orders"), "o_orderdate", "day").join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return _text(o.join(lists, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "day", "venue", "root", "n", "organisers"), "day")


@query(f"SELECT root, count(*) AS n, strftime(min(day), '%Y-%m-%d') AS next_date FROM ({UPCOMING}) GROUP BY root")
def venue_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _text(agenda.rollup(_upcoming(spark, sf), ["root"], "day"), "next_date")


@query(f"SELECT n_name AS venue, coalesce(n, 0) AS n, strftime(next_date, '%Y-%m-%d') AS next_date FROM nation LEFT JOIN (SELECT venue, count(*) AS n, min(day) AS next_date FROM ({UPCOMING}) WHERE o_orderpriority = '1-URGENT' AND day > DATE '2001-10-20' GROUP BY venue) ON venue = n_name")
def venue_index(spark: SparkSession, sf: str) -> DataFrame:
    on = agenda.rollup(_upcoming(spark, sf).where("o_orderpriority = '1-URGENT' and day > date'2001-10-20'"), ["venue"], "day")
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("venue"))
    return _text(nations.join(on, "venue", "left").select("venue", F.coalesce("n", F.lit(0)).alias("n"), "next_date"), "next_date")


@query(f"""WITH u AS (SELECT DISTINCT venue FROM ({UPCOMING}) WHERE day > DATE '2001-11-01'), past AS (
SELECT n_name AS venue, o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY n_name ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(o_orderdate AS DATE) < DATE '2001-06-15')
SELECT venue, o_orderkey, strftime(day, '%Y-%m-%d') AS day, place FROM past WHERE place <= 20 AND venue NOT IN (SELECT venue FROM u)""")
def venue_history_top20(spark: SparkSession, sf: str) -> DataFrame:
    on = _upcoming(spark, sf).where("day > date'2001-11-01'").select("venue").distinct()
    past = _day(table(spark, sf, "orders"), "o_orderdate", "day").where("day < date'2001-06-15'").join(_places(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    rows = past.join(on, "venue", "left_anti").select("venue", "o_orderkey", "day")
    return _text(agenda.latest(rows, "venue", [F.desc("day"), F.asc("o_orderkey")]).withColumn("place", F.col("place").cast("long")), "day")


@query("SELECT r_name AS root, r_name || '; ' || string_agg(n_name, '; ' ORDER BY n_name) AS family FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def venue_family_keys(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    families = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("root")).agg(F.collect_list("n_name").alias("rooms"))
    return families.select("root", F.concat_ws("; ", "root", export.joined(F.col("rooms"))).alias("family"))


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return _day(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_linestatus"), "l_shipdate", "day")


@query("""SELECT l_orderkey, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_shipdate AS DATE), l_linenumber) AS place
FROM lineitem WHERE l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= DATE '1998-06-15') WHERE place = 1""")
def next_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    wanted = (F.col("l_linestatus") == "O") & civil.upcoming(F.col("day"), "1998-06-15 10:00")
    return _text(agenda.next_occurrence(_occurrences(spark, sf), "l_orderkey", "day", wanted, "l_linenumber"), "day")


@query("""SELECT l_orderkey, strftime(day, '%Y-%m-%d') AS day, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY kind, CASE WHEN kind = 1 THEN date_diff('day', DATE '1990-01-01', day) * 10 + l_linenumber ELSE -(date_diff('day', DATE '1990-01-01', day) * 10 + l_linenumber) END) AS place
FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= DATE '1998-06-15' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS kind FROM lineitem)) WHERE place = 1""")
def relevant_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    on = civil.upcoming(F.col("day"), "1998-06-15 10:00")
    return _text(agenda.relevant_occurrence(_occurrences(spark, sf), "l_orderkey", "day", F.col("l_linestatus") == "O", on, "l_linenumber"), "day")


def _title_sql() -> str:
    sql, facts = "SELECT p_partkey, p_name AS title, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part", ["p_brand", "p_type", "p_size"]
    for k, fact in enumerate(facts):
        differ = "TRUE" if k == 0 else f"(min({fact}) OVER w IS DISTINCT FROM max({fact}) OVER w)"
        sql = f"SELECT * REPLACE (CASE WHEN count(*) OVER w > 1 AND {differ} THEN title || ' · ' || {fact} ELSE title END AS title) FROM ({sql}) WINDOW w AS (PARTITION BY title)"
    return f"SELECT p_partkey, title FROM ({sql})"


@query(_title_sql())
def document_titles(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"), "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    return agenda.distinct_titles(items, "title", ["p_brand", "p_type", "p_size"]).select("p_partkey", "title")


@query("""WITH s AS (SELECT a.p_partkey AS id, b.p_partkey AS other, 3 * CAST(a.p_brand = b.p_brand AS INTEGER) + 2 * CAST(a.p_type = b.p_type AS INTEGER) AS base, CAST(a.p_size = b.p_size AS INTEGER) AS kind FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND (a.p_brand = b.p_brand OR a.p_type = b.p_type)),
r AS (SELECT id, other, base + kind AS score, row_number() OVER (PARTITION BY id ORDER BY base + kind DESC, other) AS place FROM s QUALIFY place <= 3)
SELECT id, other, CAST(score AS BIGINT) AS score, place FROM r""")
def related_items(spark: SparkSession, sf: str) -> DataFrame:
    return agenda.related(table(spark, sf, "part"), "p_partkey", "p_brand", "p_type", "p_size").select("id", "other", F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


@query("""SELECT o_orderkey, strftime((CAST(o_orderdate AS TIMESTAMP) + INTERVAL 2 HOUR + INTERVAL 30 MINUTE) AT TIME ZONE 'Europe/Madrid' AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS utc FROM orders""")
def civil_to_utc(spark: SparkSession, sf: str) -> DataFrame:
    local = F.to_date("o_orderdate").cast("timestamp") + F.expr("interval 150 minutes")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(civil.to_utc(local), "yyyy-MM-dd HH:mm").alias("utc"))


@query(f"""SELECT o_orderkey, l_linenumber, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || '-' || l_linenumber || chr(13) || chr(10) || 'DTSTART;VALUE=DATE:' || strftime(day, '%Y%m%d') || chr(13) || chr(10)
|| 'SUMMARY:' || o_orderpriority || chr(13) || chr(10) || 'LOCATION:' || venue || '\\, ' || root || chr(13) || chr(10) || 'END:VEVENT' AS entry FROM ({UPCOMING})""")
def ics_lines(spark: SparkSession, sf: str) -> DataFrame:
    uid = F.concat_ws("-", "o_orderkey", "l_linenumber")
    return _upcoming(spark, sf).select("o_orderkey", "l_linenumber", export.ics(uid, F.col("day"), F.col("o_orderpriority"), F.concat_ws(", ", "venue", "root")).alias("entry"))


@query("""SELECT o_orderkey, strftime(min(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS first, strftime(max(CAST(l_shipdate AS DATE)), '%Y-%m-%d') AS last, count(*) AS n, string_agg(DISTINCT p_name, '; ' ORDER BY p_name) AS works
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_orderkey""")
def export_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = _day(table(spark, sf, "lineitem"), "l_shipdate", "day").select(F.col("l_orderkey").alias("o_orderkey"), "day", "l_partkey")
    named = li.join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = table(spark, sf, "orders").select("o_orderkey").join(named, "o_orderkey")
    return _text(rows.groupBy("o_orderkey").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n"), export.joined(F.collect_list("p_name")).alias("works")), "first", "last")


@query("SELECT s_suppkey, coalesce(n, 0) AS n, coalesce(orders, 0) AS orders FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY l_suppkey) ON l_suppkey = s_suppkey")
def adapter_counts(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'2001-10-01'").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey")
    return export.with_zeros(table(spark, sf, "supplier"), "s_suppkey", li.groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders")), ["n", "orders"])
