"""Names of composers and performers in what sources write."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .idents import quiet
from .text import collapse, fold, once

#: Words of a role, folded, and the role; the first that is in the text counts.
ROLES = {
    "conductor": ("director", "directora", "direccion", "conductor", "dirigent"), "orchestra": ("orquesta", "orchestra", "sinfonica", "filarmonica"), "choir": ("coro", "choir", "orfeon", "escolania"),
    "ensemble": ("cuarteto", "quartet", "trio", "ensemble", "grupo", "quinteto"), "singer": ("soprano", "mezzosoprano", "tenor", "baritono", "bajo", "contratenor", "mezzo"),
    "instrumentalist": ("piano", "violin", "viola", "violonchelo", "cello", "flauta", "guitarra", "organo", "clave", "arpa", "clarinete", "oboe"), "stage": ("escena", "escenografia", "vestuario", "dramaturgia"),
}
LIFESPAN = r"\s*\(\s*(?:n\.\s*|\*\s*)?[0-9]{4}\s*(?:[-–—]\s*(?:[0-9]{4})?)?\s*\)\s*$"
#: What stands in a composer's place and is no person.
NOBODY = ("anonimo", "anonymous", "varios", "varios autores", "various", "popular", "tradicional", "traditional", "n n")
#: Frames in which a text tells a composer; the first group is the name.
_NAME = r"(\p{Lu}[\p{L}'.-]*(?: (?:(?:de|del|la|van|von|da|di) )*\p{Lu}[\p{L}'.-]*){0,4})"
FRAMES = {"of": rf"\b(?i:obras?|música|piezas?|works?|music) (?:de|of|by) {_NAME}", "by": rf"\b(?i:compuest[oa]s? por|composed by) {_NAME}", "colon": rf"(?m)^\s*{_NAME}\s*[:–—] ", "lifespan": rf"{_NAME} \([0-9]{{4}}\s*[-–—]"}


def without_years(name: Column) -> Column:
    return F.regexp_replace(name, LIFESPAN, "")


def role(text: Column, roles: Mapping[str, tuple[str, ...]] = ROLES) -> Column:
    """The role that a text tells of, else "other"; null for an empty text."""

    def told(words: Column) -> Column:
        out = F.when(F.array_join(words, "") == "", F.lit(None).cast("string"))
        for name, any_of in roles.items():
            out = out.when(F.arrays_overlap(words, F.array(*map(F.lit, any_of))), name)
        return out.otherwise("other")

    return once(F.split(fold(F.coalesce(text, F.lit(""))), " "), told)


def composer_name(raw: Column) -> Column:
    """A composer's name without years, white space and capitals throughout; null for what is no person."""
    clean = collapse(without_years(collapse(raw)))
    return F.when((clean != "") & ~fold(clean).isin(*NOBODY), quiet(clean))


def canonical(rows: DataFrame, raw: str, aliases: DataFrame, alias: str, name: str) -> DataFrame:
    """Rows with ``composer``: the dictionary's name for the raw one, else the clean raw name; a lone surname that several have is none."""
    keyed = rows.withColumn("_clean", composer_name(F.col(raw))).withColumn("_key", fold(F.col("_clean")))
    owners = aliases.select(fold(F.col(alias)).alias("_key"), F.col(name).alias("_name")).distinct().groupBy("_key").agg(F.min("_name").alias("_name"), F.count(F.lit(1)).alias("_owners"))
    joined = keyed.join(owners, "_key", "left")
    return joined.withColumn("composer", F.when(F.col("_owners") > 1, F.lit(None)).otherwise(F.coalesce("_name", "_clean"))).drop("_clean", "_key", "_name", "_owners")


def attributions(text: Column) -> Column:
    """array of struct(frame, name): the composers that a text tells of in one of the frames."""

    def named(frame: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda n: F.struct(F.lit(frame).alias("frame"), n.alias("name")))

    found = [named(frame, pattern) for frame, pattern in FRAMES.items()]
    return F.array_distinct(F.concat(*found))


def is_nobody(text: Column) -> Column:
    """What stands for a performer but is none: no letters, an address, a price, a time, a date, or too long a sentence."""
    return ~text.rlike(r"\p{L}") | text.rlike(r"https?://|@|€|\b[0-9]{1,2}[:.][0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b") | (F.size(F.split(F.trim(text), r"\s+")) > 12) | text.rlike(r"(?i)^\s*(?:entradas?|tickets?|duración|programa|más información)\b")
