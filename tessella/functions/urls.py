"""URL identity as Columns. Null and malformed urls give null parts, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that say where a visit came from, not what the page is (any utm_ key as well).
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "igshid")
#: Path words of pages that list many things.
COLLECTIONS = ("agenda", "calendario", "calendar", "conciertos", "concerts", "events", "eventos", "programacion", "temporada", "archive", "archivo", "category", "tag", "index")
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def normalize(url: Column) -> Column:
    """Trimmed, without a fragment, host in lower case, no slashes at the path's end; what is no url stays."""
    url = F.trim(url)
    whole = F.concat(F.lower(F.regexp_extract(url, PARTS, 1)), F.lit("://"), host(url), F.regexp_replace(path(url), "/+$", ""), query(url))
    return F.when(url.rlike(PARTS), whole).otherwise(url)


def strip_tracking(url: Column) -> Column:
    """The normalised url without tracking keys, others in their order."""
    url = normalize(url)
    pairs = F.filter(F.split(F.substring(query(url), 2, 1_000_000), "&"), lambda p: (p != "") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).rlike(f"^(utm_.*|{'|'.join(TRACKING)})$"))
    kept = F.array_join(pairs, "&")
    return F.concat(F.regexp_replace(url, r"\?.*$", ""), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def kind(url: Column) -> Column:
    """"event-detail" or "listing": a path segment with a digit that is no collection's, or a last segment that is none."""
    segments = F.filter(F.split(F.lower(path(normalize(url))), "/"), lambda s: s != "")
    collection = lambda s: F.split_part(s, F.lit("-"), F.lit(1)).isin(*COLLECTIONS)
    single = F.exists(segments, lambda s: ~collection(s) & s.rlike("[0-9]"))
    return F.when(F.size(segments) <= 0, "listing").when(single, "event-detail").when(collection(F.element_at(segments, -1)), "listing").otherwise("event-detail")


def last_segment(url: Column) -> Column:
    return F.regexp_extract(normalize(url), r"/([^/?#]+)(?:\?[^#]*)?$", 1)


def parameter(url: Column, name: str) -> Column:
    """The value of a query key (the first), else null."""
    return F.nullif(F.regexp_extract(query(url), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))


def equivalent(a: Column, b: Column, id_key: str | None = None) -> Column:
    """Equal when normalised, or the same content id in the query key that a site's content system uses."""
    same = normalize(a) == normalize(b)
    return same if id_key is None else same | F.coalesce((host(a) == host(b)) & (parameter(a, id_key) == parameter(b, id_key)), F.lit(False))
