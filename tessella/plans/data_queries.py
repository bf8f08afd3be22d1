"""Validation, linkage, merge, extraction and classification over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import html, text, urls
from tessella.operators import accounting, classify, export, linkage, quality, scan
from tessella.operators.components import components
from tessella.sources.storage import table

from .agenda_queries import FOLD
from .registry import query

ISSUE = "'{}' AS code, '{}' AS severity, CAST({} AS VARCHAR) AS path, CAST({} AS VARCHAR) AS message"


@query(f"SELECT {ISSUE.format('missing-venue', 'error', 'o_orderkey', 'o_custkey')} FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') UNION ALL SELECT {ISSUE.format('missing-organizer', 'error', 'l_orderkey', 'l_suppkey')} FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    venues, organizers = table(spark, sf, "customer").where("c_mktsegment != 'BUILDING'"), table(spark, sf, "supplier").where("s_acctbal > 0")
    return quality.dangling(o, "o_orderkey", "o_custkey", venues, "c_custkey", "missing-venue").union(quality.dangling(li, "l_orderkey", "l_suppkey", organizers, "s_suppkey", "missing-organizer"))


@query(f"SELECT {ISSUE.format('duplicate-slug', 'error', 'key', 'message')} FROM (SELECT replace(lower(p_name), ' ', '-') AS key, count(*) || ' ' || min(p_partkey) || ' ' || max(p_partkey) AS message FROM part GROUP BY ALL HAVING count(*) > 1)")
def duplicate_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "part"), "p_partkey", text.slug(F.col("p_name")), "duplicate-slug")


@query(f"SELECT {ISSUE.format('duplicate-event', 'error', 'doc_id', 'first')} FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first")
def first_seen_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.later_duplicates(table(spark, sf, "documents"), "doc_id", F.sha2("text", 256), "duplicate-event")


@query("""SELECT l_suppkey, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') AS day, count(*) AS n, min(l_orderkey) AS first, count(DISTINCT l_partkey) AS facts,
CASE WHEN count(DISTINCT l_partkey) = 1 THEN 'schedule-duplicate' ELSE 'schedule-conflict' END AS code FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def schedule_collisions(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("day", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return quality.collisions(li, "l_orderkey", ["l_suppkey", "day"], "l_partkey").select("l_suppkey", "day", "n", "first", "facts", "code")


def _timed(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of users with a day and, for all but views, an hour."""
    hour = F.when(F.col("event_type") != "view", F.date_format("ts", "HH"))
    return table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), hour.alias("time"))


@query("""WITH e AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_type <> 'view' THEN strftime(ts, '%H') END AS time FROM events),
t AS (SELECT user_id, day, count(DISTINCT time) AS times, min(time) AS known FROM e GROUP BY user_id, day)
SELECT DISTINCT user_id, day, coalesce(time, known) AS time FROM e JOIN t USING (user_id, day) WHERE time IS NOT NULL OR times <= 1""")
def occurrence_precision(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.precise(_timed(spark, sf), ["user_id", "day"], "time")


@query("""WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_type = 'signup'),
s AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM a GROUP BY user_id)
SELECT DISTINCT user_id, day FROM (SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = b.user_id AND b.day BETWEEN lo AND hi))""")
def calendar_scoped_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    first, second = (e.where(F.col("event_type") == k).select("user_id", "day") for k in ("purchase", "signup"))
    return linkage.scoped_union(first, second, "user_id", "day", first.groupBy("user_id").agg(F.min("day").alias("from"), F.max("day").alias("to")))


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by hash, first line and length as what candidates are found by."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", F.md5("text").alias("whole"), F.md5(text.fold(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("title"), "lang", "source")


CANDIDATES = f"""WITH d AS (SELECT doc_id, md5(text) AS whole, md5({FOLD.replace('text', 'split_part(text, chr(10), 1)')}) AS title, lang, source FROM documents WHERE text IS NOT NULL), k AS (SELECT * FROM d WHERE source >= 'src15'), o AS (SELECT * FROM d WHERE source < 'src15'),
p AS (SELECT o.doc_id, 'url' AS method, count(DISTINCT k.doc_id) AS n, min(k.doc_id) AS first FROM o JOIN k USING (whole) GROUP BY o.doc_id UNION ALL
SELECT o.doc_id, 'strong', count(DISTINCT k.doc_id), min(k.doc_id) FROM o JOIN k USING (title, lang) GROUP BY o.doc_id)"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    d, known = _observed(spark, sf), F.col("source") >= "src15"
    return linkage.candidates(d.where(~known), d.where(known), {"url": ["whole"], "strong": ["title", "lang"]}, "doc_id", "doc_id")


@query(CANDIDATES + " SELECT * FROM p")
def identity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)


@query(CANDIDATES + " SELECT doc_id, max(n) AS n, min(first) AS first, CASE WHEN max(n) = 1 AND min(first) = max(first) THEN 'matched' WHEN count(*) FILTER (method <> 'url') = 0 THEN 'matched-many' ELSE 'ambiguous' END AS verdict FROM p GROUP BY doc_id")
def identity_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.collapse(_candidates(spark, sf), "doc_id")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a whole text, each linked to the first with it."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("key")).dropna()
    first = d.groupBy("key").agg(F.min("doc_id").alias("b"))
    return d.join(first, "key").select(F.col("doc_id").alias("a"), "b")


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {FOLD}) AS component FROM documents WHERE text IS NOT NULL")
def fresh_components(spark: SparkSession, sf: str) -> DataFrame:
    roots = components(_edges(spark, sf)).withColumnRenamed("id", "doc_id")
    ids = table(spark, sf, "documents").where("text is not null").select("doc_id")
    return ids.join(roots, "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"))


@query("SELECT md5(text) AS key, count(*) AS n, count(DISTINCT source) - 1 AS corroborations, count(*) - count(DISTINCT source) AS duplicates FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def corroboration_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").where("text is not null").select(F.md5("text").alias("key"), "source")
    return accounting.corroboration(d, "key", "source")


@query("""WITH p AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_regionkey + 100 WHEN 1 THEN NULL ELSE n_nationkey END AS place, CASE WHEN s_suppkey % 4 > 1 THEN n_regionkey + 100 END AS above FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT o_orderkey, n_nationkey AS place, n_regionkey + 100 AS above FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT relation, count(*) AS n FROM (SELECT CASE WHEN o.place IS NULL OR p.place IS NULL THEN 'absent' WHEN o.place = p.place THEN 'same' WHEN o.above = p.place THEN 'refinement' WHEN p.above = o.place THEN 'coarser' WHEN o.above = p.above THEN 'sibling' ELSE 'unrelated' END AS relation
FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN p ON l_suppkey = s_suppkey) GROUP BY relation""")
def venue_relation(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") + 100).alias("region"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    k = F.col("l_suppkey") % 4
    s = s.select("l_suppkey", F.when(k == 0, F.col("region")).when(k > 1, F.col("n_nationkey")).alias("b"), F.when(k > 1, F.col("region")).alias("bp"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey")).join(n, "n_nationkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey").select("l_orderkey", F.col("n_nationkey").alias("a"), F.col("region").alias("ap"))
    pairs = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey")
    return pairs.groupBy(linkage.venue_relation(F.col("a"), F.col("ap"), F.col("b"), F.col("bp")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Published orders (all but the urgent) and incoming ones (from 1998 on, open ones now finished)."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("checked"))
    incoming = o.where("checked >= '1998-01-01'").withColumn("status", F.when(F.col("status") == "O", "F").otherwise(F.col("status"))).withColumn("title", F.lower("title"))
    return o.where("title != '1-URGENT'"), incoming


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS checked FROM orders), p AS (SELECT * FROM o WHERE title <> '1-URGENT'),
n AS (SELECT o_orderkey, CASE WHEN status = 'O' THEN 'F' ELSE status END AS status, lower(title) AS title, checked FROM o WHERE checked >= '1998-01-01')
SELECT o_orderkey, coalesce(n.status, p.status) AS status, coalesce(p.title, n.title) AS title, greatest(p.checked, n.checked) AS checked,
CASE WHEN p.status IS NULL THEN 'created' WHEN n.status IS NULL THEN 'untouched' WHEN n.status <> p.status THEN 'updated' ELSE 'unchanged' END AS change FROM p FULL JOIN n USING (o_orderkey)""")
def merge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.upsert(*_snapshots(spark, sf), "o_orderkey", {"status": "incoming", "title": "published", "checked": "max"})


@query("""WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_linenumber <= 2))) AS p, list_sort(list_distinct(list(l_partkey))) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(CASE WHEN list_has_all(n, p) THEN list_sort(n) ELSE p END, ',') AS works FROM a WHERE p IS NOT NULL""")
def monotone_list_merge(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 2, F.col("l_partkey")))).alias("p"), F.array_sort(F.collect_set("l_partkey")).alias("n"))
    works = F.array_sort(linkage.monotone(F.col("p"), F.col("n")))
    return g.where(F.size("p") > 0).select("l_orderkey", F.array_join(works.cast("array<string>"), ",").alias("works"))


@query("""SELECT s_suppkey, o_orderkey FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_orderkey AS o_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01') WHERE s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def possibly_missing(spark: SparkSession, sf: str) -> DataFrame:
    cited = table(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz'2001-01-01'").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_orderkey").alias("o_orderkey")).distinct()
    seen = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'2001-01-01'")
    return linkage.missing(cited, "o_orderkey", "s_suppkey", table(spark, sf, "supplier").where("s_acctbal > 0"), seen).select("s_suppkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN place = 1 THEN base ELSE base || '-' || place END AS slug FROM (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS base, row_number() OVER (PARTITION BY replace(lower(p_name), ' ', '-') ORDER BY p_partkey) AS place FROM part)")
def slugify_unique(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql.window import Window

    p = table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("base"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey"))
    return p.withColumn("place", place).select("p_partkey", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "place")).alias("slug"))


ENTITIES_SQL = "{}"
for _name, _char in html.ENTITIES.items():
    ENTITIES_SQL = f"replace({ENTITIES_SQL}, '&{_name};', '{_char.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT page_id, md5(trim(regexp_replace({ENTITIES_SQL.format(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))}, '\\s+', ' ', 'g'))) AS stripped FROM pages")
def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    # the SQL decodes no numeric references, of which the driver's pages have none
    return table(spark, sf, "pages").select("page_id", F.md5(html.strip_tags(F.col("html"))).alias("stripped"))


STRIPPED = "trim(regexp_replace(" + ENTITIES_SQL.format("regexp_replace(x, '<[^>]+>', ' ', 'g')") + r", '\s+', ' ', 'g'))"


@query(rf"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '\s+', ' ', 'g'), '(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main)\b[^>]*>', chr(10), 'g') AS t FROM pages),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {STRIPPED}), lambda x: x <> '') AS blocks FROM b) SELECT page_id, CAST(i - 1 AS INTEGER) AS place, blocks[i] AS block FROM l, unnest(range(1, len(blocks) + 1)) AS u(i)""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("place", "block"))


@query("SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref=\"([^\"]*)\"', 1))) AS href FROM pages")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.explode(F.array_distinct(html.links(F.col("html")))).alias("href"))


P = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?'"
NORMAL = f"lower(regexp_extract(trim(url), {P}, 1)) || '://' || lower(regexp_extract(trim(url), {P}, 2)) || regexp_replace(regexp_extract(trim(url), {P}, 3), '/+$', '') || regexp_extract(trim(url), {P}, 4)"
CLEAN = f"""SELECT page_id, regexp_replace(u, '\\?.*$', '') || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END AS url FROM (SELECT page_id, u,
list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|fbclid|gclid|mc_cid|mc_eid|ref|igshid)$')) AS kept FROM (SELECT page_id, {NORMAL} AS u FROM pages))"""


@query(f"SELECT page_id, {NORMAL} AS url FROM pages")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query(CLEAN)
def url_tracking_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.strip_tracking(F.col("url")).alias("url"))


_IN = ", ".join(f"'{c}'" for c in urls.COLLECTIONS)


@query(f"""SELECT page_id, CASE WHEN len(s) = 0 THEN 'listing' WHEN len(list_filter(s, lambda x: split_part(x, '-', 1) NOT IN ({_IN}) AND regexp_matches(x, '[0-9]'))) > 0 THEN 'event-detail'
WHEN split_part(s[-1], '-', 1) IN ({_IN}) THEN 'listing' ELSE 'event-detail' END AS kind FROM (SELECT page_id, list_filter(string_split(lower(regexp_extract(trim(url), {P}, 3)), '/'), lambda x: x <> '') AS s FROM pages)""")
def url_kind(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.kind(F.col("url")).alias("kind"))


def _rules_sql(rules: dict) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(f, '(^|[^a-z0-9])(?:{'|'.join(words)})([^a-z0-9]|$)') THEN '{name}'" for name, words in rules.items()) + " END"


@query(f"""SELECT doc_id, CASE WHEN x IS NOT NULL AND i IS NOT NULL THEN CASE WHEN n_chars >= 2000 THEN 'include' WHEN x = 'popular-music-identity' THEN 'exclude' ELSE 'uncertain' END WHEN x IS NOT NULL THEN 'exclude' WHEN i IS NOT NULL THEN 'include' ELSE 'uncertain' END AS value,
CASE WHEN x IS NOT NULL AND i IS NOT NULL THEN CASE WHEN n_chars >= 2000 THEN 'mixed-program-classical-block' WHEN x = 'popular-music-identity' THEN x ELSE 'classical-and-nonclassical-coprincipal' END WHEN x IS NOT NULL THEN x WHEN i IS NOT NULL THEN i ELSE 'insufficient-evidence' END AS rule_id
FROM (SELECT doc_id, n_chars, {_rules_sql(classify.EXCLUSIONS)} AS x, {_rules_sql(classify.INCLUSIONS)} AS i FROM (SELECT doc_id, n_chars, {FOLD} AS f FROM documents))""")
def classify_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    first = lambda rules: F.try_element_at(classify.hits(F.col("words"), rules), F.lit(1))
    said = d.select("doc_id", (F.col("n_chars") >= 2000).alias("long"), classify.words_of(F.col("text")).alias("words"))
    found = said.select("doc_id", "long", first(classify.EXCLUSIONS).alias("x"), first(classify.INCLUSIONS).alias("i"))
    return found.select("doc_id", classify.eligibility(F.col("x"), F.col("i"), F.col("long")).alias("v")).select("doc_id", "v.value", "v.rule_id")


@query(f"""SELECT conv_id, turn, CASE WHEN f = '' THEN 'unknown' WHEN free THEN 'free' WHEN paid THEN 'paid' ELSE 'unknown' END AS value, CASE WHEN f = '' THEN 'access-missing' WHEN free THEN 'access-free' WHEN paid THEN 'access-paid' ELSE 'access-unclear' END AS rule_id
FROM (SELECT *, f IN ('1', 'true', 'free', 'gratis') OR regexp_matches(f, '(^|[^a-z0-9])(?:gratis|gratuit[oa]s?|free|kostenlos)([^a-z0-9]|$)') OR regexp_matches(f, 'entrada libre|acceso libre|libre hasta completar aforo') AS free,
f IN ('0', 'false', 'paid') OR regexp_matches(f, '(^|[^a-z0-9])(?:precios?|tickets?|euros?|eur|entradas)([^a-z0-9]|$)') AS paid FROM (SELECT conv_id, turn, coalesce({FOLD}, '') AS f FROM conversations))""")
def classify_access(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", classify.access(F.col("text")).alias("v")).select("conv_id", "turn", "v.value", "v.rule_id")


def _aliases(spark: SparkSession, sf: str) -> DataFrame:
    """The first two and first three words of every test item stand for a dictionary's names."""
    w = F.split(text.fold(F.col("text")), " ")
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.array(F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 1, 3), " "))).alias("alias"))
    return b.select("alias", F.concat(F.lit("item "), F.col("item_id")).alias("name"))


DICTIONARY = f"""WITH k AS (SELECT DISTINCT item_id, w[:n] AS g, n FROM (SELECT item_id, string_split({FOLD}, ' ') AS w, unnest([2, 3]) AS n FROM benchmark) WHERE len(w) >= n),
d AS (SELECT doc_id, string_split({FOLD}, ' ') AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d)
SELECT doc_id, 'item ' || item_id AS name, CAST(s AS INTEGER) AS start, n AS n_words FROM t JOIN k ON w[s + 1] = g[1] AND w[s + 1:s + n] = g"""


@query(DICTIONARY)
def dictionary_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan.spans(table(spark, sf, "documents"), "doc_id", "text", _aliases(spark, sf), "alias", "name")


@query(f"""WITH m AS ({DICTIONARY}), g AS (SELECT doc_id, list([{{'name': name, 'start': start, 'n': n_words}}] ORDER BY -n_words, start, name) AS s FROM m GROUP BY doc_id),
r AS (SELECT doc_id, unnest(list_reduce(s, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.start < x[1].start + x[1].n AND x[1].start < y.start + y.n)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS k FROM g) SELECT doc_id, k.name AS name, k.start AS start, k.n AS n_words FROM r""")
def longest_span_wins(spark: SparkSession, sf: str) -> DataFrame:
    return scan.spans(table(spark, sf, "documents"), "doc_id", "text", _aliases(spark, sf), "alias", "name", longest_wins=True)


GUARDED = f"""WITH k AS (SELECT DISTINCT item_id, w[a:b] AS g, b - a + 1 AS n FROM (SELECT item_id, string_split({FOLD}, ' ') AS w FROM benchmark), (VALUES (1, 3), (4, 5), (2, 6), (1, 1000)) t(a, e), LATERAL (SELECT least(e, len(w)) AS b) WHERE a <= b),
gd AS (SELECT DISTINCT string_split({FOLD}, ' ')[1] AS g FROM benchmark), d AS (SELECT doc_id, string_split({FOLD}, ' ') AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(0, len(w))) AS s FROM d)
SELECT doc_id, 'item ' || item_id AS name, CAST(s AS INTEGER) AS start, n AS n_words FROM t JOIN k ON w[s + 1] = g[1] AND w[s + 1:s + n] = k.g WHERE s = 0 OR w[s] NOT IN (SELECT g FROM gd)"""


@query(GUARDED)
def guarded_alias_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Aliases of two words up to whole items, not right behind a word that opens an item."""
    w = F.split(text.fold(F.col("text")), " ")
    b = table(spark, sf, "benchmark").select("item_id", w.alias("w"))
    part = lambda a, e: F.array_join(F.slice("w", a, e - a + 1), " ")
    names = b.select(F.concat(F.lit("item "), "item_id").alias("name"), F.explode(F.array(part(1, 3), part(4, 5), part(2, 6), part(1, 1000))).alias("alias"))
    guards = sorted(r[0] for r in b.select(F.element_at("w", 1)).distinct().collect())  # a word an item at most
    return scan.spans(table(spark, sf, "documents"), "doc_id", "text", names, "alias", "name", guards=guards)


@query("SELECT l_orderkey, array_to_string(list_filter(['PROMO', 'SMALL', 'STANDARD', 'MEDIUM', 'LARGE', 'ECONOMY'], lambda x: list_contains(h, x)), ',') AS eras FROM (SELECT l_orderkey, list(split_part(p_type, ' ', 1)) AS h FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)")
def era_ordered_set(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf, "part").select("p_partkey", F.split_part("p_type", F.lit(" "), F.lit(1)).alias("era"))
    sets = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("era").alias("eras"))
    return sets.select("l_orderkey", F.array_join(classify.in_order(F.col("eras"), ("PROMO", "SMALL", "STANDARD", "MEDIUM", "LARGE", "ECONOMY")), ",").alias("eras"))


def _filled(c: str) -> Column:
    return F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")


@query("SELECT source, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) <> '') AS texts, count(*) FILTER (trim(coalesce(lang, '')) <> '') AS langs FROM documents GROUP BY source")
def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), _filled("text").alias("texts"), _filled("lang").alias("langs"))


@query(f"SELECT doc_id, CASE WHEN k >= 3 THEN 'rich' WHEN k >= 1 THEN 'partial' ELSE 'sparse' END AS richness FROM (SELECT doc_id, CAST(n_chars >= 500 AS INTEGER) + CAST(contains(text, chr(10)) AS INTEGER) + CAST(regexp_matches(text, '[0-9]') AS INTEGER) + CAST(contains({FOLD}, ' con ') AS INTEGER) AS k FROM documents)")
def evidence_richness(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    k = sum(c.cast("int") for c in (F.col("n_chars") >= 500, F.contains(t, F.lit("\n")), t.rlike("[0-9]"), F.contains(text.fold(t), F.lit(" con "))))
    return table(spark, sf, "documents").select("doc_id", F.when(k >= 3, "rich").when(k >= 1, "partial").otherwise("sparse").alias("richness"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, md5(string_agg) AS joined FROM (SELECT doc_id, text, array_to_string(list_sort(list_distinct(string_split(text, chr(10)))), '; ') AS string_agg FROM documents WHERE text IS NOT NULL)")
def list_export(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.size(lines).alias("lines"), F.md5(export.joined(lines)).alias("joined"))
