"""Files for those outside over the driver's tables: orders as sessions, nations as places, suppliers as performers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import sinks
from tessella.sources.storage import table

from .registry import query

_ESC = "replace(replace(replace({0}, chr(92), chr(92) || chr(92)), ';', chr(92) || ';'), ',', chr(92) || ',')"
_FOLD = "array_to_string(list_transform(range(0, CAST(greatest(ceil((length({0}) - 1) / 74.0), 1) AS BIGINT)), lambda i: substr({0}, CASE WHEN i = 0 THEN 1 ELSE i * 74 + 2 END, CASE WHEN i = 0 THEN 75 ELSE 74 END)), chr(13) || chr(10) || ' ')"
_TOLD = "'Order ' || o_orderkey || ' of ' || c_name || ', ' || lower(o_orderpriority) || '; held in ' || n_name || ', ' || r_name || ', on ' || strftime(o_orderdate, '%Y-%m-%d') || ' and told of here at some length'"
_SESSIONS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _sessions(spark: SparkSession, sf: str) -> DataFrame:
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    told = F.concat(F.lit("Order "), "o_orderkey", F.lit(" of "), "c_name", F.lit(", "), F.lower("o_orderpriority"), F.lit("; held in "), "n_name", F.lit(", "), "r_name", F.lit(", on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" and told of here at some length"))
    status = F.when(F.col("o_orderstatus") == "F", "cancelled").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled")
    time = F.when(F.col("o_totalprice") > 200000, "20:00").when(F.col("o_totalprice") > 100000, "00:30")
    return rows.withColumns({"day": F.to_date("o_orderdate"), "told": told, "status": status, "time": time, "ident": F.col("o_orderkey").cast("string")})


_LINES = f"""'BEGIN:VCALENDAR', 'VERSION:2.0', 'PRODID:-//tessella//agenda//ES', 'CALSCALE:GREGORIAN', 'BEGIN:VEVENT', 'UID:' || o_orderkey || '@tessella.example', 'DTSTAMP:' || strftime(o_orderdate - INTERVAL 9 DAY, '%Y%m%d') || 'T000000Z',
CASE WHEN o_totalprice > 100000 THEN 'DTSTART:' || strftime((CAST(strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_totalprice > 200000 THEN ' 20:00:00' ELSE ' 00:30:00' END AS TIMESTAMP) AT TIME ZONE 'Europe/Madrid') AT TIME ZONE 'UTC', '%Y%m%dT%H%M%SZ') ELSE 'DTSTART;VALUE=DATE:' || strftime(o_orderdate, '%Y%m%d') END,
{_FOLD.format("('SUMMARY:' || " + _ESC.format("o_orderpriority") + ")")}, {_FOLD.format("('LOCATION:' || " + _ESC.format("n_name || '; ' || r_name") + ")")}, {_FOLD.format("('DESCRIPTION:' || " + _ESC.format(_TOLD) + ")")},
'URL:https://tessella.example/e/' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'STATUS:CANCELLED' END, 'END:VEVENT', 'END:VCALENDAR'"""


@query(f"SELECT o_orderkey, array_to_string(list_filter([{_LINES}], lambda x: x IS NOT NULL), chr(13) || chr(10)) || chr(13) || chr(10) AS document FROM {_SESSIONS}")
def calendar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A whole calendar file of every order, at any time of the year, timed or not."""
    s = _sessions(spark, sf)
    place = F.concat("n_name", F.lit("; "), "r_name")
    document = sinks.calendar(F.concat("ident", F.lit("@tessella.example")), F.col("day"), F.col("time"), F.col("o_orderpriority"), place, F.col("told"), F.concat(F.lit("https://tessella.example/e/"), "ident"), F.date_sub("day", 9), F.col("status"))
    return s.select("o_orderkey", document.alias("document"))


@query(f"""WITH p AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT {{n: s_name, r: CASE WHEN s_acctbal < 0 THEN 'MusicGroup' ELSE 'Person' END}})) AS ps FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'N' GROUP BY 1)
SELECT o_orderkey, '{{"@context":"https://schema.org","@type":"MusicEvent","@id":"https://tessella.example/e/' || o_orderkey || '#' || o_orderkey || '","name":"' || o_orderpriority || '","startDate":"' || strftime(o_orderdate, '%Y-%m-%d') || '","eventStatus":"https://schema.org/' || CASE o_orderstatus WHEN 'F' THEN 'EventCancelled' WHEN 'P' THEN 'EventPostponed' ELSE 'EventScheduled' END
|| '","eventAttendanceMode":"https://schema.org/OfflineEventAttendanceMode","location":{{"@type":"Place","name":"' || n_name || '"}},"url":"https://tessella.example/e/' || o_orderkey || '"' || CASE WHEN o_totalprice < 50000 THEN ',"isAccessibleForFree":true' WHEN o_totalprice > 300000 THEN ',"isAccessibleForFree":false' ELSE '' END
|| ',"organizer":[{{"@type":"Organization","name":"' || c_name || '"}}]' || CASE WHEN ps IS NULL THEN '' ELSE ',"performer":[' || array_to_string(list_transform(ps, lambda x: '{{"@type":"' || x.r || '","name":"' || x.n || '"}}'), ',') || ']' END || CASE WHEN o_orderpriority < '4' THEN ',"superEvent":{{"@type":"EventSeries","name":"' || r_name || '"}}' ELSE '' END || '}}' AS json
FROM {_SESSIONS} LEFT JOIN p ON p.k = o_orderkey""")
def structured_events(spark: SparkSession, sf: str) -> DataFrame:
    s, li, su = _sessions(spark, sf), table(spark, sf, "lineitem").where("l_returnflag = 'N'"), table(spark, sf, "supplier")
    role = F.when(F.col("s_acctbal") < 0, "choir").otherwise("soloist")
    people = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("s_name").alias("name"), role.alias("role")))).alias("people"))
    rows = s.join(people, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    access, series = F.when(F.col("o_totalprice") < 50000, "free").when(F.col("o_totalprice") > 300000, "paid").otherwise("unknown"), F.when(F.col("o_orderpriority") < "4", F.col("r_name"))
    url = F.concat(F.lit("https://tessella.example/e/"), "ident")
    json = sinks.structured(F.col("o_orderpriority"), F.date_format("day", "yyyy-MM-dd"), F.col("status"), F.col("n_name"), url, F.col("ident"), access, F.col("people"), F.array("c_name"), series)
    return rows.select("o_orderkey", json.alias("json"))


@query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages), n AS (SELECT path, row_number() OVER (ORDER BY path) AS place FROM p), f AS (SELECT *, (place - 1) // 100 AS file FROM n)
SELECT file, place, '<url><loc>https://tessella.example/' || replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc></url>' AS line FROM f
UNION ALL SELECT file, min(place) - 1, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' FROM f GROUP BY file UNION ALL SELECT file, max(place) + 1, '</urlset>' FROM f GROUP BY file""")
def site_map_files(spark: SparkSession, sf: str) -> DataFrame:
    """The pages' paths in site maps of a hundred each."""
    paths = table(spark, sf, "pages").select(F.regexp_replace("url", "^https?://[^/]+/", "").alias("path")).distinct()
    return sinks.site_maps(paths, "https://tessella.example/", "path", most=100)
