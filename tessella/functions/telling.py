"""Texts cut to size, queries and secrets made safe, addresses with campaign keys, and stable hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .text import collapse, once

SECRETS = r"(?i)((?:api[_-]?key|token|secret|password|authorization)[\"']?\s*[:=]\s*[\"']?(?:bearer\s+)?)[A-Za-z0-9._~+/=-]{4,}"


def compact(text: Column, most: int = 160) -> Column:
    """The text in one line, cut at the last word that fits with an ellipsis."""

    def told(t: Column) -> Column:
        cut = F.regexp_replace(F.left(t, F.lit(most - 1)), r"\s+\S*$", "")
        return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.–—-]+$", ""), F.lit("…")))

    return once(collapse(text), told)


def facts(values: Column, most: int = 3, separator: str = ", ", more: str = " y {} más") -> Column:
    """The first few of a list, and how many more there are."""
    left = F.size(values) - most
    before, after = more.split("{}")
    return F.concat(F.array_join(F.slice(values, 1, most), separator), F.when(left > 0, F.concat(F.lit(before), left.cast("string"), F.lit(after))).otherwise(""))


def safe_query(text: Column, most: int = 80) -> Column:
    """A search text fit to be counted: one line, lower case, without what looks like an address or a number to call."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(collapse(text)), r"\S+@\S+", "<mail>"), r"\+?[0-9][0-9 ().-]{7,}[0-9]", "<number>")
    return F.left(clean, F.lit(most))


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRETS, "$1***")


def stable_hash(*columns: str) -> Column:
    """A hash of values as JSON, names in order and nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def with_campaign(url: Column, source: str, medium: str, campaign: str) -> Column:
    """The normalised address with utm keys, after those that it has."""
    base = urls.strip_tracking(url)
    keys = f"utm_source={source}&utm_medium={medium}&utm_campaign={campaign}"
    return F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit(keys))


def page_kind(path: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    """The first kind whose pattern the path matches, else "other"."""
    out = F.when(path == "/", "home")
    for pattern, name in kinds:
        out = out.when(path.rlike(pattern), name)
    return out.otherwise("other")
