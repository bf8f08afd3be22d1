"""References, merged lists and citations, composers' identities and the health of runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import classify, composers, discovery, merging, resolve, run_health
from tessella.sources.storage import table

from .data_queries import FOLD
from .registry import query

PLACE = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with place, organisers in the order of their lines, series and primary source (the first line's)."""
    o, c, li = (table(spark, sf, t) for t in ("orders", "customer", "lineitem"))
    at = F.struct(*PLACE)
    lines = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "l_suppkey"))), lambda x: x["l_suppkey"]).alias("organizers"), F.min_by("l_suppkey", at).alias("primary"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    series = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
    return rows.select(F.col("o_orderkey").alias("k"), F.col("c_nationkey").alias("venue_key"), "organizers", series.alias("series_key"), "primary")


@query("""SELECT o_orderkey AS k, n_name AS venue, coalesce(names, '') AS organizers, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN lower(o_orderpriority) END AS series FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, string_agg(s_name, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) ON l_orderkey = o_orderkey""")
def resolved_events(spark: SparkSession, sf: str) -> DataFrame:
    e, s = _events(spark, sf), table(spark, sf, "supplier")
    series = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("id"), F.lower("o_orderpriority").alias("name")).distinct()
    e = resolve.one(e, "k", "venue_key", table(spark, sf, "nation"), "n_nationkey", "venue")
    e = resolve.one(resolve.many(e, "k", "organizers", s, "s_suppkey", "told"), "k", "series_key", series, "id", "series")
    return e.select("k", F.col("venue.n_name").alias("venue"), F.array_join(F.transform("told", lambda x: x["s_name"]), "; ").alias("organizers"), F.col("series.name").alias("series"))


@query("""WITH p AS (SELECT l_orderkey AS k, arg_min(l_suppkey, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS prim FROM lineitem GROUP BY 1) SELECT DISTINCT l_orderkey AS k, s_name AS source, l_suppkey = prim AS is_primary FROM lineitem JOIN p ON k = l_orderkey JOIN supplier ON s_suppkey = l_suppkey""")
def primary_citations(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_suppkey").distinct()
    out = resolve.citations(cited, "k", "l_suppkey", _events(spark, sf), "primary", table(spark, sf, "supplier"), "s_suppkey")
    return out.select("k", F.col("source_row.s_name").alias("source"), "is_primary")


ITEMS = """WITH it AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_shipdate AS d, l_tax, p_name AS name, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS note, CASE WHEN p_size > 5 THEN lower(p_brand) ELSE '' END AS key FROM lineitem JOIN part ON p_partkey = l_partkey),
o0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s, d) AS i FROM it WHERE l_tax < 0.05), n0 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n, p, s, d) AS i FROM it WHERE l_tax >= 0.02),
o AS (SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY i) AS nth FROM o0), n AS (SELECT *, row_number() OVER (PARTITION BY k, key ORDER BY i) AS nth FROM n0),
ks AS (SELECT k, count(DISTINCT CASE WHEN side = 1 THEN i END) AS olds, count(DISTINCT CASE WHEN side = 2 THEN i END) AS news FROM (SELECT k, i, 1 AS side FROM o UNION ALL SELECT k, i, 2 FROM n) GROUP BY k),
wh AS (SELECT ks.*, NOT EXISTS (SELECT 1 FROM o WHERE o.k = ks.k AND o.key <> '' AND NOT EXISTS (SELECT 1 FROM n WHERE n.k = o.k AND n.key = o.key)) AS whole FROM ks),
vals AS (SELECT o.k, 1 AS part, o.i, o.name, o.key, CASE WHEN m.k IS NOT NULL THEN coalesce(o.note, m.note) ELSE o.note END AS note FROM o LEFT JOIN n m ON m.k = o.k AND m.key = o.key AND m.nth = o.nth AND o.key <> ''
UNION ALL SELECT n.k, 2, n.i, n.name, n.key, n.note FROM n JOIN wh USING (k) WHERE olds = 0 OR (whole AND n.key <> '' AND n.nth = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.k = n.k AND o.key = n.key))),
agg AS (SELECT k, string_agg(name || ':' || coalesce(note, '-'), ',' ORDER BY part, i) AS value, string_agg(name || ':' || coalesce(note, '-') || ':' || key, ',' ORDER BY part, i) AS whole_value, count(*) AS many FROM vals GROUP BY k), inc AS (SELECT k, string_agg(name || ':' || coalesce(note, '-') || ':' || key, ',' ORDER BY i) AS told FROM n GROUP BY k)
SELECT k, value, CASE WHEN olds = 0 OR news = 0 THEN false ELSE NOT (whole_value = told OR (whole AND many > olds)) END AS differs FROM agg JOIN wh USING (k) LEFT JOIN inc USING (k)"""


@query(ITEMS)
def merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with a low tax as a published list, those with a higher one as what came in; a brand is an item's identity, small parts have none."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    item = F.struct(F.col("p_name").alias("name"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("note"), F.when(F.col("p_size") > 5, F.lower("p_brand")).otherwise("").alias("key"))
    side = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct(*PLACE, item.alias("item"))))), lambda x: x["item"])
    both = li.groupBy(F.col("l_orderkey").alias("k")).agg(side(F.col("l_tax") < 0.05).alias("old"), side(F.col("l_tax") >= 0.02).alias("new"))
    enrich = lambda a, b: a.withField("note", F.coalesce(a["note"], b["note"]))
    out = both.select("k", merging.lists(F.col("old"), F.col("new"), lambda x: x["key"], enrich).alias("m"))
    said = F.transform("m.value", lambda x: F.concat(x["name"], F.lit(":"), F.coalesce(x["note"], F.lit("-"))))
    return out.select("k", F.array_join(said, ",").alias("value"), F.col("m.differs").alias("differs"))


@query("""WITH c AS (SELECT l_suppkey AS k, l_returnflag AS source, l_partkey AS p, l_linestatus = 'O' AS new, CASE WHEN l_linestatus = 'F' THEN 'https://www.x.example/p?id=' || l_partkey ELSE 'http://www.x.example/q/?z=1&id=' || l_partkey END AS url,
strftime(l_shipdate, '%Y-%m-%d') AS checked, CASE WHEN l_tax > 0.05 THEN 'e' || l_orderkey END AS ext, l_orderkey AS o, l_linenumber AS n FROM lineitem)
SELECT k, source, arg_min(url, (new, o, n, url)) AS url, arg_max(checked, (new, o, n, checked)) AS checked, arg_max(ext, (new, o, n, checked)) FILTER (ext IS NOT NULL) AS external FROM c GROUP BY k, source, p""")
def citation_merge(spark: SparkSession, sf: str) -> DataFrame:
    li, new = table(spark, sf, "lineitem"), F.col("l_linestatus") == "O"
    url = F.when(new, F.concat(F.lit("http://www.x.example/q/?z=1&id="), "l_partkey")).otherwise(F.concat(F.lit("https://WWW.x.example/p?id="), "l_partkey"))
    rows = li.select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("source"), url.alias("url"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("checked"), F.when(F.col("l_tax") > 0.05, F.concat(F.lit("e"), "l_orderkey")).alias("external"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), new.alias("new"))
    out = merging.citations(rows.where(~F.col("new")), rows.where("new"), "k", "source", "url", "checked", "external", order=["o", "n"], id_key="id")
    return out.withColumn("url", F.replace("url", F.lit("WWW"), F.lit("www")))


def _written() -> Column:
    """A brand as sources write composers, by the size of the part."""
    size, brand = F.col("p_size"), F.col("p_brand")
    bare = F.replace(F.upper(brand), F.lit("#"), F.lit(""))
    return F.when(size <= 10, brand).when(size <= 20, F.concat(F.lit("Música de "), brand)).when(size <= 30, bare).when(size <= 40, F.concat(brand, F.lit(" (1770-1827)"))).otherwise(F.concat(F.lit("Atribuida a "), brand))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand").distinct().where("p_brand < 'Brand#4'")
    return p.select(F.col("p_brand").alias("alias"), F.concat(F.lit("Composer "), "p_brand").alias("name"))


BRAND = "replace(lower(p_brand), '#', ' ')"
WRITTEN = f"""WITH w AS (SELECT p_partkey, p_size, p_brand, CASE WHEN p_size <= 10 THEN p_brand WHEN p_size <= 20 THEN 'Música de ' || p_brand WHEN p_size <= 30 THEN replace(upper(p_brand), '#', '') WHEN p_size <= 40 THEN p_brand || ' (1770-1827)' ELSE 'Atribuida a ' || p_brand END AS written,
CASE WHEN p_brand < 'Brand#4' THEN 'Composer ' || p_brand END AS composer, CASE WHEN p_brand < 'Brand#4' THEN CASE WHEN p_size <= 20 THEN 'alias' WHEN p_size <= 30 THEN 'compact' WHEN p_size <= 40 THEN 'years' ELSE 'attribution' END END AS stage,
CASE WHEN p_brand < 'Brand#4' THEN 'Composer ' || p_brand WHEN p_size <= 20 THEN {BRAND} WHEN p_size <= 30 THEN replace(lower(p_brand), '#', '') WHEN p_size <= 40 THEN {BRAND} || ' 1770 1827' ELSE 'atribuida a ' || {BRAND} END AS identity FROM part)"""


@query(f"{WRITTEN} SELECT p_partkey, composer, stage, identity FROM w")
def composer_identities(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", _written().alias("written"))
    return composers.identified(p, ["p_partkey"], "written", _dictionary(spark, sf), "alias", "name").select("p_partkey", "composer", "stage", "identity")


@query(f"""{WRITTEN}, l AS (SELECT DISTINCT l_orderkey AS k, lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || '-' || l_partkey || '-' || l_suppkey AS o, written, identity FROM lineitem JOIN w ON p_partkey = l_partkey)
SELECT 'composer-identity' AS code, 'error' AS severity, CAST(k AS VARCHAR) AS path, identity || ': ' || string_agg(written, ' | ' ORDER BY o, written) AS message FROM l GROUP BY k, identity HAVING count(*) > 1""")
def composer_repeats(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), _written().alias("written"))
    ident = F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), "l_partkey", "l_suppkey")
    rows = table(spark, sf, "lineitem").join(p, "l_partkey").select(F.col("l_orderkey").alias("k"), ident.alias("o"), "written").distinct()
    return composers.repeated(composers.identified(rows, ["k", "o"], "written", _dictionary(spark, sf), "alias", "name"), "k", "o", "written")


@query(f"""WITH b AS (SELECT item_id, string_split({FOLD}, ' ') AS w, length(text) AS n FROM benchmark), k AS (SELECT DISTINCT 'item ' || item_id AS name, w[1:2] AS g, (['early', 'renaissance', 'baroque', 'classical', 'romantic', 'twentieth', 'contemporary'])[1 + n % 7] AS era FROM b WHERE len(w) >= 2),
d AS (SELECT doc_id, string_split({FOLD}, ' ') AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d), m AS (SELECT DISTINCT doc_id, name, CAST(s AS INTEGER) AS start, 2 AS n_words FROM t JOIN k ON w[s + 1] = g[1] AND w[s + 1:s + 2] = g),
g AS (SELECT doc_id, list([{{'name': name, 'start': start, 'n': n_words}}] ORDER BY start, name) AS s FROM m GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(s, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.start < x[1].start + x[1].n AND x[1].start < y.start + y.n)) > 0 THEN acc ELSE list_concat(acc, x) END)).name AS name FROM g),
e AS (SELECT r.doc_id, k.name, k.era FROM r JOIN k USING (name))
SELECT doc_id, array_to_string(list_filter(['early', 'renaissance', 'baroque', 'classical', 'romantic', 'twentieth', 'contemporary'], lambda x: list_contains(list(era), x)), ',') AS eras, string_agg(DISTINCT name, ',' ORDER BY name) AS composers FROM e GROUP BY doc_id""")
def eras_from_programme_text(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(text.fold(F.col("text")), " ")
    eras = F.array(F.element_at(F.array(*map(F.lit, classify.ERAS)), F.length("text") % 7 + 1))
    names = table(spark, sf, "benchmark").where(F.size(w) >= 2).select(F.array_join(F.slice(w, 1, 2), " ").alias("alias"), F.concat(F.lit("item "), "item_id").alias("name"), eras.alias("eras"))
    out = composers.eras_told(table(spark, sf, "documents"), "doc_id", "text", names, "alias", "name", "eras", classify.ERAS)
    return out.select("doc_id", F.array_join("eras", ",").alias("eras"), F.array_join("composers", ",").alias("composers"))


HEALTH = """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS run, user_id, event_type, value FROM events),
s AS (SELECT run, user_id, bool_or(event_type = 'purchase' AND value > 300) AS usable, bool_or(event_type <> 'error') AS extracted, count(*) FILTER (event_type = 'error') >= 3 AS severe, CASE WHEN max(value) > 350 THEN 'stale' WHEN max(value) > 300 THEN 'partial' WHEN max(value) > 5 THEN 'complete' END AS coverage FROM e GROUP BY ALL),
r AS (SELECT run, max(value) < 460 AS batch_ok, CASE WHEN min(value) < 0.02 THEN ['low-value'] ELSE [] END AS fatal, count(*) FILTER (value > 420 AND event_type = 'click') AS ambiguous, count(*) FILTER (value BETWEEN 400 AND 410) AS missing, count(*) FILTER (value > 380 AND event_type = 'view') AS composers FROM e GROUP BY run),
f AS (SELECT run, 0 AS place, 'invalid-batch' AS reason, 4 AS level FROM r WHERE NOT batch_ok UNION ALL SELECT run, 1, 'no-sources-succeeded', 4 FROM s GROUP BY run HAVING NOT bool_or(usable) UNION ALL SELECT run, 2, unnest(fatal), 4 FROM r
UNION ALL SELECT run, 3, 'source-coverage-' || coverage, 2 FROM s WHERE coverage <> 'complete' UNION ALL SELECT run, 4, 'source-failed', 3 FROM s WHERE NOT extracted UNION ALL SELECT run, 5, 'source-hydration-incomplete', 3 FROM s WHERE severe
UNION ALL SELECT run, 10, 'ambiguous', 3 FROM r WHERE ambiguous > 0 UNION ALL SELECT run, 11, 'possibly-missing', 2 FROM r WHERE missing > 0 UNION ALL SELECT run, 12, 'unresolved-composers', 2 FROM r WHERE composers > 0)"""


@query(f"""{HEALTH}, g AS (SELECT run, place, reason, max(level) AS level, count(*) AS n FROM f GROUP BY ALL)
SELECT run, (['clean', 'degraded', 'review', 'fatal'])[coalesce(max(level), 1)] AS health, coalesce(max(level), 1) <= 2 AS auto_merge, CAST(coalesce(sum(n), 0) AS BIGINT) AS findings, coalesce(string_agg(reason, ' ' ORDER BY place, reason), '') AS reasons FROM r LEFT JOIN g USING (run) GROUP BY run""")
def run_health_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Days as runs, users as their sources."""
    e = table(spark, sf, "events").withColumn("run", F.date_format("ts", "yyyy-MM-dd"))
    kind, value, most = F.col("event_type"), F.col("value"), F.max("value")
    sources = e.groupBy("run", "user_id").agg(
        F.max((kind == "purchase") & (value > 300)).alias("usable"), F.max(kind != "error").alias("extracted"), (F.count_if(kind == "error") >= 3).alias("hydration_severe"), F.when(most > 350, "stale").when(most > 300, "partial").when(most > 5, "complete").alias("coverage"),
    )
    runs = e.groupBy("run").agg(
        (most < 460).alias("batch_ok"), F.when(F.min("value") < 0.02, F.array(F.lit("low-value"))).otherwise(F.array().cast("array<string>")).alias("fatal"), F.count_if((value > 420) & (kind == "click")).alias("ambiguous"),
        F.count_if(value.between(400, 410)).alias("possibly_missing"), F.count_if((value > 380) & (kind == "view")).alias("unresolved_composers"),
    )
    return run_health.evaluated(runs, run_health.findings(runs, sources, "run", "user_id"), "run")


def _brought(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as observations from outside: their addresses, first headings and lengths tell what else an observation has."""
    p = table(spark, sf, "pages")
    heading = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    day, size = F.regexp_extract("url", r"/([0-9]+)", 1).cast("int"), F.length("html")
    date = F.concat(F.lit("2024-"), F.lpad((day % 13).cast("string"), 2, "0"), F.lit("-"), F.lpad((day % 31 + 1).cast("string"), 2, "0"))
    sessions = F.when(size > 1500, F.array(F.struct(date.alias("date"), F.concat((day % 26).cast("string"), F.lit(":00")).alias("time")))).otherwise(F.array().cast("array<struct<date:string,time:string>>"))
    return p.select(
        "page_id", "url", F.when(size % 10 > 0, heading).alias("title"), sessions.alias("occurrences"), F.when(size > 2000, heading).alias("description"), F.when(size > 2500, heading).alias("programme"), F.when(size > 3000, heading).alias("venue"), F.when(size > 4000, heading).alias("external"), F.regexp_extract("url", "^[^:]*://[^/]*/([^/]*)/", 1).alias("via"),
    )


BROUGHT = r"""WITH p AS (SELECT page_id, url, length(html) AS size, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h, CAST(regexp_extract(url, '/([0-9]+)', 1) AS INT) AS d, regexp_extract(url, '^[^:]*://[^/]*/([^/]*)/', 1) AS via, regexp_replace(lower(regexp_extract(url, '^[^:]*://([^/?#]*)', 1)), '^www\.', '') AS site FROM pages),
o AS (SELECT *, CASE WHEN size % 10 > 0 THEN h END AS title, '2024-' || lpad(CAST(d % 13 AS VARCHAR), 2, '0') || '-' || lpad(CAST(d % 31 + 1 AS VARCHAR), 2, '0') AS date FROM p),
pr AS (SELECT *, list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'event.title: missing' END, CASE WHEN size <= 1500 THEN 'event.occurrences: missing' END,
CASE WHEN size > 1500 THEN CASE WHEN try_cast(date AS DATE) IS NULL THEN 'event.occurrences.0.date: no day of the calendar' WHEN NOT regexp_matches((d % 26) || ':00', '^(?:[01][0-9]|2[0-3]):[0-5][0-9]$') THEN 'event.occurrences.0.time: no time of day' END END], lambda x: x IS NOT NULL) AS problems FROM o),
hosts AS (SELECT site, count(*) AS n FROM p GROUP BY site HAVING count(*) >= 4)"""


@query(f"{BROUGHT} SELECT page_id, array_to_string(problems, '; ') AS problems FROM pr")
def discovery_problems(spark: SparkSession, sf: str) -> DataFrame:
    found = discovery.problems(F.col("title"), F.col("url"), F.col("occurrences"))
    return _brought(spark, sf).select("page_id", F.array_join(found, "; ").alias("problems"))


def _registered(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with four pages at least as the sources that an adapter reads."""
    sites = table(spark, sf, "pages").groupBy(discovery.site(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return sites.select(F.concat(F.lit("reg_"), F.replace("site", F.lit("."), F.lit("_"))).alias("source"), F.concat(F.lit("https://WWW."), "site", F.lit("/home")).alias("home"))


@query(f"{BROUGHT} SELECT 'reg_' || replace(site, '.', '_') AS source, count(*) AS n, min(url) AS first, max(url) AS last FROM pr JOIN hosts USING (site) WHERE len(problems) = 0 GROUP BY site")
def discovery_adapter_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = _brought(spark, sf).where(F.size(discovery.problems(F.col("title"), F.col("url"), F.col("occurrences"))) == 0)
    known = _registered(spark, sf)
    return discovery.adapter_gaps(discovery.sourced(rows, "url", known, "source", "home"), known, "source", "url", "title")


@query(f"{BROUGHT} SELECT page_id, CASE WHEN hosts.site IS NOT NULL THEN 'reg_' || replace(pr.site, '.', '_') ELSE 'src_' || trim(regexp_replace(pr.site, '[^a-z0-9]+', '_', 'g'), '_') END AS source, hosts.site IS NOT NULL AS known FROM pr LEFT JOIN hosts USING (site)")
def discovery_sources(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.sourced(_brought(spark, sf), "url", _registered(spark, sf), "source", "home").select("page_id", "source", "known")


@query(f"{BROUGHT} SELECT via, count(*) AS n, count(*) FILTER (len(problems) = 0) AS usable, count(*) FILTER (size <= 2500 OR h = '') AS sparse FROM pr GROUP BY via")
def discovery_yields(spark: SparkSession, sf: str) -> DataFrame:
    """What each language of pages brought; all their addresses tell of single pages."""
    rows = discovery.evidence(_brought(spark, sf), "url").withColumn("problems", discovery.problems(F.col("title"), F.col("url"), F.col("occurrences")))
    return discovery.yields(rows, "via").select("via", "n", "usable", "sparse")
