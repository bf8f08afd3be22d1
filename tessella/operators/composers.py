"""Composers by a dictionary that the user gives: whom a name means, in which stage, and what a catalogue has twice.

``dictionary``: (alias, name), with any further columns such as eras. A name is tried as it is, without spaces, without years, without words of attribution, and with surname and given names in turn;
all tries of all distinct names meet the dictionary in one join, and the first in that order that meets an entry counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.people import without_years
from tessella.functions.text import collapse, fold

from . import scan

#: Words that a source puts before a name, and frames of attribution; extend to taste.
LABEL = r"(?i)^(?:(?:música|music|music by|composer|compositor[a]?)(?: de| of)?\s*:?\s+)+"
ATTRIBUTED = r"(?i)^(?:atribuid[oa]s? a|attributed to|attr\.?)\s+"
STAGES = ("alias", "compact", "years", "attribution", "inverted")


def unlabelled(name: Column) -> Column:
    return collapse(F.regexp_replace(collapse(name), LABEL, ""))


def _tries(name: Column) -> Column:
    """array of struct(stage, key): folded tries are words, compact ones have no space."""
    bare = without_years(name)
    own = F.regexp_replace(bare, ATTRIBUTED, "")
    turned = F.when(F.size(F.split(own, ",")) == 2, F.concat_ws(" ", F.trim(F.split_part(own, F.lit(","), F.lit(2))), F.trim(F.split_part(own, F.lit(","), F.lit(1)))))
    forms = [("alias", fold(name)), ("compact", F.replace(fold(name), F.lit(" "))), ("years", fold(bare)), ("attribution", fold(own)), ("inverted", fold(turned))]
    each = F.array(*(F.struct(F.lit(i).alias("stage"), F.concat(F.lit("c:" if stage == "compact" else "f:"), key).alias("key")) for i, (stage, key) in enumerate(forms)))
    return F.filter(each, lambda t: t["key"].isNotNull() & (F.length(t["key"]) > 2))


def entries(dictionary: DataFrame, alias: str, name: str) -> DataFrame:
    """(key, name) of each form of each alias; a form that two composers have is nobody's, and so is a surname alone that two names end in."""
    folded = dictionary.select(fold(F.col(alias)).alias("a"), F.col(name).alias("name")).where("a != ''").distinct()
    forms = folded.select(F.concat(F.lit("f:"), "a").alias("key"), "name").union(folded.select(F.concat(F.lit("c:"), F.replace("a", F.lit(" "))), "name"))
    sole = forms.groupBy("key").agg(F.min("name").alias("name"), F.max("name").alias("_last")).where("name = _last").drop("_last")
    surnames = dictionary.select(F.col(name).alias("n")).distinct().groupBy(F.element_at(F.split(fold(F.col("n")), " "), -1).alias("s")).agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")
    return sole.join(surnames.select(F.concat(F.lit("f:"), "s").alias("key")), "key", "left_anti").join(surnames.select(F.concat(F.lit("c:"), "s").alias("key")), "key", "left_anti")


def identified(rows: DataFrame, id_cols: Sequence[str], name: str, dictionary: DataFrame, alias: str, canonical: str) -> DataFrame:
    """rows with ``composer`` (the dictionary's name, or null), ``stage`` and ``identity`` (the composer, else the folded name without its label)."""
    # spellings recur in very many rows: each is folded and looked up once
    names = rows.select(F.col(name).alias("_n")).where("_n is not null").distinct().withColumn("_clean", unlabelled(F.col("_n")))
    asked = names.select("_n", F.explode(_tries(F.col("_clean"))).alias("t")).select("_n", "t.stage", "t.key")
    best = asked.join(entries(dictionary, alias, canonical).withColumnRenamed("name", "_name"), "key").groupBy("_n").agg(F.min(F.struct("stage", "_name")).alias("_b"))
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("_b.stage") + 1)
    known = names.join(best, "_n", "left").select("_n", F.col("_b._name").alias("composer"), F.when(F.col("_b").isNotNull(), stage).alias("stage"), F.coalesce(F.col("_b._name"), fold(F.col("_clean"))).alias("identity"))
    return rows.join(known, F.col(name) == F.col("_n"), "left").drop("_n")


def repeated(identities: DataFrame, event: str, order: str, name: str) -> DataFrame:
    """(code, severity, path, message): events that name one composer twice, under whatever spellings, which are told in order."""
    groups = identities.where("identity != ''").groupBy(event, "identity").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name]), " | ").alias("names"))
    return groups.where("n > 1").select(F.lit("composer-identity").alias("code"), F.lit("error").alias("severity"), F.col(event).cast("string").alias("path"), F.concat(F.col("identity"), F.lit(": "), F.col("names")).alias("message"))


def eras_told(docs: DataFrame, id_col: str, programme: str, dictionary: DataFrame, alias: str, name: str, eras: str, order: Sequence[str], guards: Sequence[str] = ()) -> DataFrame:
    """(id, eras, composers): the eras of the composers whom a programme's text names, in the taxonomy's order; texts that name nobody give no row."""
    usable = dictionary.where(F.length(fold(F.col(alias))) >= 4)
    named = scan.spans(docs, id_col, programme, usable, alias, name, guards, longest_wins=True).select(id_col, "name").distinct()
    known = dictionary.select(F.col(name).alias("name"), F.explode(eras).alias("_era")).distinct()
    met = named.join(known, "name", "left").groupBy(id_col).agg(F.collect_set("_era").alias("_eras"), F.array_sort(F.collect_set("name")).alias("composers"))
    return met.select(id_col, F.array_intersect(F.array(*map(F.lit, order)), F.col("_eras")).alias("eras"), "composers")
