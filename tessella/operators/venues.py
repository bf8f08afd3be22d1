"""Which place an observation names: ranked lookups, and places to be created.

Every lookup is a key and a rank. A row's keys and the dictionary's keys meet in one join, however many lookups there are, and one aggregate keeps each row's best hit. By rank:

1. the source's own facility identifier; 2. what the source proposes with name, municipality and area, if a place of that name is there;
then for each spelling of the text (whole, without what is in brackets, before the first comma): 3. a spelling that the source is known for, 4. the name of one place of the catalogue
alone, 5. an alias, of a place in the catalogue or a known one that isn't yet. 6. What is left and has a name, municipality, area and address is to be created, rows of one name and
municipality as one place.

Dictionaries are frames that the user gives, not lists in code: ``catalogue`` (place, name, municipality), ``facilities`` (source, facility, place), ``source_names`` (source, name, place),
``aliases`` (name, place). Nulls and empty texts match nothing; a place that two entries of one key give is ambiguous and doesn't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.idents import tail
from tessella.functions.text import fold

FACILITY, PROPOSED, SOURCE_NAME, NAME, ALIAS = "facility", "proposed", "source-name", "name", "alias"


def spellings(text: Column) -> Column:
    """The folded text, without a part in brackets at its end, and before the first comma or dash: those that differ, in this order."""
    bare = F.regexp_replace(text, r"\s*\([^()]*\)\s*$", "")
    return F.filter(F.array_distinct(F.array(fold(text), fold(bare), fold(F.regexp_replace(bare, r"\s*(?:,| [-–—] ).*$", "")))), lambda s: s.isNotNull() & (s != ""))


def _key(kind: str, *parts: Column) -> Column:
    """A lookup's key; null where a part is null or empty."""
    known = F.lit(True)
    for p in parts:
        known = known & (F.coalesce(p, F.lit("")) != "")
    return F.when(known, F.concat_ws("\x1f", F.lit(kind), *parts))


def dictionary(catalogue: DataFrame, facilities: DataFrame, source_names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, target, there): what each key of each lookup leads to, unless that is ambiguous, and whether the place is in the catalogue."""
    col = F.col
    place = lambda: col("place").cast("string").alias("target")
    rows = facilities.select(_key(FACILITY, col("source"), col("facility")).alias("key"), place())
    rows = rows.union(catalogue.select(_key(PROPOSED, fold(col("name")), fold(col("municipality"))), place())).union(source_names.select(_key(SOURCE_NAME, col("source"), fold(col("name"))), place()))
    rows = rows.union(catalogue.select(_key(NAME, fold(col("name"))), place())).union(aliases.select(_key(ALIAS, fold(col("name"))), place()))
    sole = rows.where("key is not null").groupBy("key").agg(F.min("target").alias("target"), F.max("target").alias("_last")).where("target = _last").drop("_last")
    known = catalogue.select(place()).distinct().withColumn("there", F.lit(True))
    return sole.join(known, "target", "left").select("key", "target", F.coalesce("there", F.lit(False)).alias("there"))


def resolved(rows: DataFrame, id_col: str, entries: DataFrame) -> DataFrame:
    """(id, target, method, state, reason): the place of each row, by which lookup, and what it is: "catalogue", "known" (to be published with the row), "new", or null with a reason.

    rows: id, source, facility, text, and what the source proposes: name, municipality, area, address.
    """
    c = F.col
    told = (F.coalesce(F.trim("name"), F.lit("")) != "") & (F.coalesce(F.trim("municipality"), F.lit("")) != "") & (F.coalesce(F.trim("area"), F.lit("")) != "")
    first = F.array(F.struct(F.lit(1).alias("rank"), _key(FACILITY, c("source"), c("facility")).alias("key")), F.struct(F.lit(2).alias("rank"), F.when(told, _key(PROPOSED, fold(c("name")), fold(c("municipality")))).alias("key")))

    def of_spelling(s: Column, i: Column) -> Column:
        at = lambda k, key: F.struct((3 + 3 * i + k).alias("rank"), key.alias("key"))
        return F.array(at(0, _key(SOURCE_NAME, c("source"), s)), at(1, _key(NAME, s)), at(2, _key(ALIAS, s)))

    asked = F.concat(first, F.coalesce(F.flatten(F.transform(spellings(c("text")), of_spelling)), F.array().cast("array<struct<rank:int,key:string>>")))
    each = rows.select(c(id_col).alias("_id"), F.explode(F.filter(asked, lambda a: a["key"].isNotNull())).alias("a")).select("_id", "a.rank", "a.key")
    best = each.join(entries, "key").groupBy("_id").agg(F.min(F.struct("rank", "key", "target", "there")).alias("b"))
    out = rows.join(best, c(id_col) == c("_id"), "left")
    new_place = F.concat(F.lit("ven_"), tail(F.concat_ws(" ", "name", "municipality"), 116))
    complete = told & (F.coalesce(F.trim("address"), F.lit("")) != "")
    state = F.when(c("b").isNotNull(), F.when(c("b.there"), "catalogue").otherwise("known")).when(complete, "new")
    reason = F.when(c("b").isNotNull() | complete, None).when(told, "lugar nuevo con datos insuficientes").otherwise("lugar no reconocido")
    target = F.when(c("b").isNotNull(), c("b.target")).when(complete, new_place)
    method = F.when(c("b").isNotNull(), F.split_part("b.key", F.lit("\x1f"), F.lit(1))).when(complete, "created")
    return out.select(id_col, target.alias("target"), method.alias("method"), state.alias("state"), reason.alias("reason"))


def created(rows: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """(target, name, municipality, area, address, n): the places to create, each once, as the row with the smallest id proposes it."""
    own = found.where("state = 'new'").select(id_col, "target").join(rows, id_col)
    fields = ("name", "municipality", "area", "address")
    out = own.groupBy("target").agg(F.min_by(F.struct(*fields), id_col).alias("p"), F.count(F.lit(1)).alias("n"))
    return out.select("target", *(f"p.{f}" for f in fields), "n")
