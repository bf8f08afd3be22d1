"""Places by ranked lookups, structural differences, partial listings and programmes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import html
from tessella.operators import changes, coverage, filters, programme, venues
from tessella.sources.storage import table

from .data_queries import STRIPPED
from .registry import query


def _observed_places(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as observations that tell of places in the manner of their segment, and the dictionaries of nations as places."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    where = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = c.join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    money, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    text = F.when(segment == "BUILDING", F.concat("n_name", F.lit(" ("), "r_name", F.lit(")"))).when(segment == "AUTOMOBILE", F.concat(F.lit("The "), "n_name")).when(segment == "MACHINERY", F.concat(F.lit("Branch "), F.col("c_nationkey").cast("string")))
    text = text.when(segment == "HOUSEHOLD", F.concat("r_name", F.lit(" Hall, upper floor")))
    observed = rows.select(
        F.col("c_custkey").alias("id"), segment.alias("source"), F.when(money < -500, F.concat(F.lit("f"), F.col("c_nationkey").cast("string"))).alias("facility"), text.alias("text"), F.when(money > 8000, F.when(money > 9800, F.col("n_name")).otherwise(F.col("c_name"))).alias("name"),
        F.when(money > 8000, F.when(money > 9800, F.col("r_name")).otherwise(F.col("n_name"))).alias("municipality"), F.when(money > 8500, "nearby").alias("area"), F.when(money > 9000, F.concat(F.lit("calle "), F.col("c_nationkey").cast("string"))).alias("address"),
    )
    of = lambda df, *cols: df.select(*cols, F.col("n_nationkey").cast("string").alias("place"))
    catalogue = of(where, F.col("n_name").alias("name"), F.col("r_name").alias("municipality"))
    known = c.select("c_mktsegment", "c_nationkey").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    facilities = of(known.where("n_regionkey > 0"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("facility"))
    names = of(known, F.col("c_mktsegment").alias("source"), F.concat(F.lit("branch "), F.col("n_nationkey").cast("string")).alias("name"))
    aliases = of(n.where("n_regionkey < 3"), F.concat(F.lit("the "), "n_name").alias("name")).union(r.select(F.concat("r_name", F.lit(" hall")), F.concat(F.lit("known-"), F.col("r_regionkey").cast("string"))))
    return observed, venues.dictionary(catalogue, facilities, names, aliases)


LADDER = """WITH c AS (SELECT *, c_acctbal AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
hit AS (SELECT c_custkey AS id, c_name, n_name, c_nationkey, m, CASE WHEN m < -500 AND n_regionkey > 0 THEN 'facility' WHEN m > 9800 THEN 'proposed' WHEN c_mktsegment = 'MACHINERY' THEN 'source-name' WHEN c_mktsegment = 'BUILDING' THEN 'name' WHEN c_mktsegment = 'AUTOMOBILE' AND n_regionkey < 3 THEN 'alias' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'alias' END AS method,
CASE WHEN m < -500 AND n_regionkey > 0 OR m > 9800 THEN false ELSE c_mktsegment = 'HOUSEHOLD' END AS known, n_regionkey FROM c),
told AS (SELECT id, CASE WHEN method IS NOT NULL THEN CASE WHEN known THEN 'known-' || n_regionkey ELSE CAST(c_nationkey AS VARCHAR) END WHEN m > 9000 THEN 'ven_' || replace(trim(regexp_replace(lower(c_name || ' ' || n_name), '[^a-z0-9]+', ' ', 'g')), ' ', '_') END AS target,
CASE WHEN method IS NOT NULL THEN method WHEN m > 9000 THEN 'created' END AS method, CASE WHEN method IS NOT NULL THEN CASE WHEN known THEN 'known' ELSE 'catalogue' END WHEN m > 9000 THEN 'new' END AS state,
CASE WHEN method IS NOT NULL OR m > 9000 THEN NULL WHEN m > 8500 THEN 'lugar nuevo con datos insuficientes' ELSE 'lugar no reconocido' END AS reason, c_name, n_name, c_nationkey FROM hit)"""


@query(f"{LADDER} SELECT id, target, method, state, reason FROM told")
def venue_ladder(spark: SparkSession, sf: str) -> DataFrame:
    observed, entries = _observed_places(spark, sf)
    return venues.resolved(observed, "id", entries)


@query(f"{LADDER} SELECT target, min(c_name) AS name, min(n_name) AS municipality, 'nearby' AS area, 'calle ' || min(c_nationkey) AS address, count(*) AS n FROM told WHERE state = 'new' GROUP BY target")
def venue_creation(spark: SparkSession, sf: str) -> DataFrame:
    observed, entries = _observed_places(spark, sf)
    return venues.created(observed, "id", venues.resolved(observed, "id", entries))


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders with their lines as nested values, and the same after corrections: other statuses, quantities, missing lines and orders."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("int").alias("quantity"), F.struct(F.col("l_returnflag").alias("flag"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).alias("sent"))
    before = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    fixed = line.withField("quantity", F.when(F.col("l_discount") == 0.1, F.col("l_quantity").cast("int") + 1).otherwise(F.col("l_quantity").cast("int"))).withField("sent.flag", F.when(F.col("l_tax") == 0.01, None).otherwise(F.col("l_returnflag")))
    after = li.where("l_tax < 0.08").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(fixed)).alias("lines"))
    head = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice", "o_custkey")
    first = head.where("o_custkey >= 20").join(before, F.col("k") == F.col("l_orderkey"), "left").select("k", "status", "priority", "lines")
    second = head.where("o_custkey < 1000").withColumn("status", F.when(F.col("o_totalprice") > 450000, "X").otherwise(F.col("status"))).withColumn("priority", F.when(F.col("o_totalprice") > 480000, None).otherwise(F.col("priority")))
    return first, second.join(after, F.col("k") == F.col("l_orderkey"), "left").select("k", "status", "priority", "lines")


_LINE = "{{n: l_linenumber, part: l_partkey, supplier: l_suppkey, quantity: {q}, flag: {f}, day: strftime(l_shipdate, '%Y-%m-%d')}}"
DIFF = f"""WITH la AS (SELECT l_orderkey AS k, list_sort(list({_LINE.format(q='CAST(l_quantity AS INT)', f='l_returnflag')})) AS lines FROM lineitem GROUP BY 1),
lb AS (SELECT l_orderkey AS k, list_sort(list({_LINE.format(q='CAST(l_quantity AS INT) + CASE WHEN l_discount = 0.1 THEN 1 ELSE 0 END', f='CASE WHEN l_tax <> 0.01 THEN l_returnflag END')})) AS lines FROM lineitem WHERE l_tax < 0.08 GROUP BY 1),
a AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, lines FROM orders LEFT JOIN la ON la.k = o_orderkey WHERE o_custkey >= 20),
b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice <= 480000 THEN o_orderpriority END AS priority, lines FROM orders LEFT JOIN lb ON lb.k = o_orderkey WHERE o_custkey < 1000),
both_ AS (SELECT k, a.k IS NULL AS na, b.k IS NULL AS nb, a.status AS sa, b.status AS sb, a.priority AS pa, b.priority AS pb, a.lines AS xa, b.lines AS xb FROM a FULL JOIN b USING (k)),
el AS (SELECT k, i - 1 AS i, xa[i] AS x, xb[i] AS y FROM (SELECT * FROM both_ WHERE NOT na AND NOT nb AND xa IS NOT NULL AND xb IS NOT NULL), unnest(range(1, greatest(len(xa), len(xb)) + 1)) AS u(i)),
d AS (SELECT k, '' AS path, CASE WHEN na THEN NULL ELSE 'whole' END AS before, CASE WHEN nb THEN NULL ELSE 'whole' END AS after FROM both_ WHERE na OR nb
UNION ALL SELECT k, 'status', sa, sb FROM both_ WHERE NOT na AND NOT nb AND sa IS DISTINCT FROM sb UNION ALL SELECT k, 'priority', pa, pb FROM both_ WHERE NOT na AND NOT nb AND pa IS DISTINCT FROM pb
UNION ALL SELECT k, 'lines', CASE WHEN xa IS NOT NULL THEN 'whole' END, CASE WHEN xb IS NOT NULL THEN 'whole' END FROM both_ WHERE NOT na AND NOT nb AND (xa IS NULL) <> (xb IS NULL)
UNION ALL SELECT k, 'lines[' || i || ']', CASE WHEN x IS NOT NULL THEN 'whole' END, CASE WHEN y IS NOT NULL THEN 'whole' END FROM el WHERE (x IS NULL) <> (y IS NULL)
{"".join(f" UNION ALL SELECT k, 'lines[' || i || '].{p}', CAST(x.{c} AS VARCHAR), CAST(y.{c} AS VARCHAR) FROM el WHERE x IS NOT NULL AND y IS NOT NULL AND x.{c} IS DISTINCT FROM y.{c}" for p, c in (("n", "n"), ("part", "part"), ("supplier", "supplier"), ("quantity", "quantity"), ("sent.flag", "flag"), ("sent.day", "day")))})"""


@query(f"{DIFF} SELECT k, path, before, after FROM d")
def structural_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Every value that differs; whole rows, lists and lines are named, not shown."""
    found = changes.differences(*_versions(spark, sf), "k")
    whole = F.col("path").rlike(r"^$|^lines$|\]$")
    return found.select("k", "path", *(F.when(whole & F.col(c).isNotNull(), "whole").otherwise(F.col(c)).alias(c) for c in ("before", "after")))


@query(rf"{DIFF} SELECT regexp_replace(path, '\[[0-9]+\]', '[]', 'g') AS path, count(*) AS n FROM d GROUP BY 1")
def diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    return changes.summary(changes.differences(*_versions(spark, sf), "k"))


LISTED = """WITH pg AS (SELECT l_suppkey AS source, l_linenumber AS page, CASE WHEN l_suppkey % 2 = 0 THEN max(max(l_linenumber)) OVER (PARTITION BY l_suppkey) ELSE 3 END AS expected, 2 * count(*) FILTER (l_discount >= 0.05) > count(*) AS ok, CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem GROUP BY l_suppkey, l_linenumber),
cov AS (SELECT source, count(*) FILTER (ok) >= max(expected) AS whole, min(a) FILTER (ok) AS a, max(b) FILTER (ok) AS b, CASE WHEN count(*) FILTER (ok) = 0 THEN 'failed' WHEN count(*) FILTER (ok) < max(expected) THEN 'incomplete-listing' END AS reason FROM pg GROUP BY source)"""


def _listing(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_linenumber").alias("page"), "l_discount", F.to_date("l_shipdate").alias("day"))
    pages = li.groupBy("source", "page").agg((2 * F.count_if(F.col("l_discount") >= 0.05) > F.count(F.lit(1))).alias("ok"), F.min("day").alias("a"), F.max("day").alias("b"))
    most = li.groupBy("source").agg(F.max("page").alias("most"))
    pages = pages.join(most, "source").withColumn("expected", F.when(F.col("source") % 2 == 0, F.col("most")).otherwise(3))
    return coverage.covered(pages, "source", "expected", "ok", "a", "b")


@query(f"{LISTED} SELECT source, whole, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last, reason FROM cov")
def listing_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return _listing(spark, sf).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first", "last")})


@query(f"""{LISTED}, p AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS source, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_tax < 0.04), s AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS source FROM lineitem WHERE l_tax >= 0.02)
SELECT k, p.source, strftime(day, '%Y-%m-%d') AS day, CASE WHEN coalesce(whole, false) AND reason IS NULL AND coalesce(day BETWEEN a AND b, false) THEN 'possibly-missing' ELSE 'withheld' END AS state FROM p LEFT JOIN cov USING (source)
WHERE day >= DATE '2001-06-01' AND (k, p.source) NOT IN (SELECT (k, source) FROM s)""")
def withheld_missing(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("source"), F.to_date("l_shipdate").alias("day"), "l_tax")
    out = coverage.unseen(li.where("l_tax < 0.04").select("k", "source", "day").distinct(), li.where("l_tax >= 0.02"), _listing(spark, sf), "k", "source", "day", "2001-06-01")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


#: Rules for the driver's pages, whose words are invented: shapes of lines stand for words.
SHAPES = (("notice", "^©"), ("cast-heading", r"^[^. ]{1,5}$"), ("other-heading", r"^[^. ]{9,}$"), ("programme-heading", r"^[^. ]{6,8}$"), ("role", r", [^,.]{1,12}\.?$"), ("composer", r"^[^.]*$"), ("work", r"^.{120,}$"))
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(f, '{p}') THEN '{k}'" for k, p in SHAPES) + " ELSE 'text' END"
SEGMENTS = rf"""WITH hb AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '\s+', ' ', 'g'), '(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|aside|main)\b[^>]*>', chr(10), 'g') AS t FROM pages),
hl AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: {STRIPPED}), lambda x: x <> '') AS blocks FROM hb),
ln AS (SELECT page_id, CAST(i - 1 AS INTEGER) AS place, blocks[i] AS line, strip_accents(lower(blocks[i])) AS f FROM hl, unnest(range(1, len(blocks) + 1)) AS u(i)), kd AS (SELECT *, {_KIND} AS kind FROM ln),
hd AS (SELECT *, last_value(CASE kind WHEN 'cast-heading' THEN 'cast' WHEN 'programme-heading' THEN 'programme' WHEN 'other-heading' THEN 'other' END IGNORE NULLS) OVER w AS head,
first_value(CASE WHEN kind NOT IN ('composer', 'notice') THEN kind END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM kd WINDOW w AS (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
op AS (SELECT *, max(CAST(head IS NULL AND (kind = 'work' OR (kind = 'composer' AND nx = 'work')) AS INT)) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM hd),
sg AS (SELECT page_id, place, line, kind, CASE WHEN kind = 'notice' THEN 'notice' WHEN kind IN ('cast-heading', 'programme-heading', 'other-heading') THEN 'heading' WHEN head IS NOT NULL THEN head WHEN opened = 1 THEN 'programme' WHEN kind = 'role' THEN 'cast' ELSE 'open' END AS section FROM op)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "pages").select("page_id", F.posexplode(html.blocks(F.col("html"))).alias("place", "line"))
    return programme.segmented(lines, "page_id", "place", "line", SHAPES)


@query(f"{SEGMENTS} SELECT page_id, place, kind, section FROM sg")
def programme_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("page_id", "place", "kind", "section")


@query(rf"""{SEGMENTS}, cp AS (SELECT *, nullif(last_value(CASE WHEN kind = 'composer' AND section = 'programme' THEN trim(regexp_replace(line, '\s*\([^()]*\)$', '')) WHEN section = 'heading' THEN '' END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS composer FROM sg),
fl AS (SELECT *, CASE WHEN section = 'notice' THEN 'notice' WHEN section = 'programme' AND kind = 'work' THEN 'work' WHEN section = 'cast' AND kind IN ('role', 'text') THEN 'performer' END AS field FROM cp)
SELECT page_id, place, field, CASE WHEN field = 'performer' AND kind = 'role' THEN regexp_extract(line, '^(.*?)\s*[,:(]\s*([^,:()]*)\)?\s*$', 1) ELSE line END AS name,
CASE WHEN field = 'work' THEN composer WHEN field = 'performer' AND kind = 'role' THEN trim(regexp_extract(line, '^(.*?)\s*[,:(]\s*([^,:()]*)\)?\s*$', 2)) END AS detail FROM fl WHERE field IS NOT NULL""")
def programme_patches(spark: SparkSession, sf: str) -> DataFrame:
    return programme.patches(_segments(spark, sf), "page_id", "place", "line")


FITS = """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS pr, o_orderstatus AS st, o_totalprice AS price, c_mktsegment AS seg, c_acctbal AS money, c_name, n_name, n_nationkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT o_orderkey, (money <= 5000 OR day >= DATE '1998-01-01') AND CASE seg WHEN 'BUILDING' THEN n_regionkey < 2 WHEN 'AUTOMOBILE' THEN pr = '1-URGENT' WHEN 'MACHINERY' THEN price > 200000 WHEN 'HOUSEHOLD' THEN true ELSE contains(lower(pr), 'low') AND st = 'F' END AS fits,
CASE WHEN seg = 'HOUSEHOLD' THEN replace(lower(n_name), '_', '-') END AS venue FROM t"""


@query(FITS)
def slim_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each order, as a slim row, passes its customer's filters, which come from an address; rooms in them become their places."""
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    segment, slug = F.col("c_mktsegment"), F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))
    room = F.concat(F.lit("room-"), F.col("n_nationkey").cast("string"))
    own = F.when(segment == "BUILDING", "area=madrid").when(segment == "AUTOMOBILE", "access=free&kind=none").when(segment == "MACHINERY", "format=organ&format=opera").when(segment == "HOUSEHOLD", F.concat(F.lit("venue="), room, F.lit("&q=customer+"))).otherwise("composer=LOW&era=early")
    asked = F.concat(F.lit("?"), F.when(F.col("c_acctbal") > 5000, "from=1998-01-01&").otherwise("from=never&"), own)
    none = F.array().cast("array<string>")
    resolved = rows.select(
        F.col("o_orderkey").alias("occurrence"), F.to_date("o_orderdate").alias("date"), F.lit(None).cast("string").alias("time"), F.when(F.col("o_orderpriority") == "1-URGENT", "free").otherwise("paid").alias("access"),
        F.when(F.col("o_totalprice") > 200000, F.array(F.lit("organ"), F.lit("lied"))).otherwise(F.array(F.lit("opera"))).alias("formats"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("early"))).otherwise(none).alias("eras"), F.lit("established").alias("kind"),
        F.when(F.col("n_regionkey") < 2, "madrid").otherwise("nearby").alias("area"), F.col("n_name").alias("municipality"), slug.alias("venue_slug"), F.array(slug, room).alias("venue_keys"), F.col("c_name").alias("title"), F.col("n_name").alias("root_name"), F.lit(None).cast("string").alias("space_name"),
        F.col("n_name").alias("venue_name"), F.lit(None).cast("string").alias("series_name"), none.alias("organizer_names"), none.alias("performer_names"), F.array("o_orderpriority").alias("composer_names"), none.alias("work_titles"), none.alias("work_composers"), asked.alias("asked"),
    )
    slim = filters.slim(resolved).join(resolved.select("occurrence", filters.parsed(F.col("asked")).alias("f")), "occurrence").withColumn("venue", F.element_at("f", F.lit("venue")))
    places = n.select(F.concat(F.lit("room-"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_nationkey").cast("string").alias("id"), slug.alias("root_slug"))
    out = filters.canonical_venue(slim, "venue", places)
    return out.select(F.col("occurrence").alias("o_orderkey"), filters.fits(F.col("f")).alias("fits"), "venue")
