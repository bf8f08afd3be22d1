"""Text folding, slugs and phrase tests as Columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters that decompose to an ASCII letter and marks, and those letters."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and c.islower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accents()


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unaccent(text: Column) -> Column:
    """Lower case, without the marks of Latin letters."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case, no accents, anything but a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(unaccent(text), "[^a-z0-9]+", " "))


def collated(text: Column, locale: str = "es") -> Column:
    """The text under a locale's collation, to sort by: accents and capitals come after plain letters of the same kind, n before ñ."""
    return F.collate(text, locale)


def contains(haystack: Column, needle: str) -> Column:
    """Folded substring; an empty needle is in everything."""
    return F.lit(True) if not needle.strip() else F.contains(fold(haystack), fold(F.lit(needle)))


def has_word(folded: Column, word: str) -> Column:
    return folded.rlike(rf"(^|[^a-z0-9]){word}([^a-z0-9]|$)")


def has_span(haystack: Column, needle: Column) -> Column:
    """The folded needle is in the folded haystack as whole words."""
    pad = lambda c: F.concat(F.lit(" "), fold(c), F.lit(" "))
    return F.contains(pad(haystack), pad(needle))


def slug(text: Column, most: int = 120, default: str = "evento") -> Column:
    cut = F.regexp_replace(F.left(F.replace(fold(text), F.lit(" "), F.lit("-")), F.lit(most)), "-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def clauses(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?;])\s+|\n+")
