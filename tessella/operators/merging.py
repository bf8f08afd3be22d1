"""Published lists and citations after a source has told its own: matched by identity, enriched, extended only where nothing would be lost."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import urls
from tessella.functions.text import once

Item = Callable[[Column], Column]


def _numbered(items: Column, identity: Item) -> Column:
    """Items as structs (item, key, nth): the item's identity and how many before it have the same."""
    keyed = F.transform(items, lambda x: F.struct(x.alias("item"), F.coalesce(identity(x), F.lit("")).alias("key")))
    return once(keyed, lambda k: F.transform(k, lambda x, i: F.struct(x["item"].alias("item"), x["key"].alias("key"), F.size(F.filter(F.slice(k, F.lit(1), i), lambda y: y["key"] == x["key"])).alias("nth"))))


def lists(published: Column, incoming: Column, identity: Item, enrich: Callable[[Column, Column], Column]) -> Column:
    """struct(value, differs): the published list with what the incoming one tells of the same items.

    An empty side gives the other one. Published items keep their order; the n-th of an identity is enriched by the n-th incoming one of that identity; those without an identity stay as
    they are. Items that are new are added, one an identity, only if incoming has every identity that is published; else ``differs`` is true, as it is where the result isn't what
    came in. Lists are one event's.
    """
    old, new = published, incoming
    both = F.struct(_numbered(old, identity).alias("old"), _numbered(new, identity).alias("new"))

    def merged(b: Column) -> Column:
        mate = lambda x: F.try_element_at(F.filter(b["new"], lambda y: (y["key"] == x["key"]) & (y["nth"] == x["nth"]) & (x["key"] != "")), F.lit(1))
        kept = F.transform(b["old"], lambda x: once(mate(x), lambda m: F.when(m.isNull(), x["item"]).otherwise(enrich(x["item"], m["item"]))))
        has = lambda side, key: F.exists(side, lambda y: y["key"] == key)
        whole = F.forall(b["old"], lambda x: (x["key"] == "") | has(b["new"], x["key"]))
        extra = F.transform(F.filter(b["new"], lambda y: (y["key"] != "") & (y["nth"] == 0) & ~has(b["old"], y["key"])), lambda y: y["item"])
        value = F.when(whole, F.concat(kept, extra)).otherwise(kept)
        return once(value, lambda v: F.struct(v.alias("value"), (~(v.eqNullSafe(new) | (whole & (F.size(v) > F.size(old))))).alias("differs")))

    simple = lambda v: F.struct(v.alias("value"), F.lit(False).alias("differs"))
    return F.when(F.coalesce(F.size(new), F.lit(0)) <= 0, simple(old)).when(F.coalesce(F.size(old), F.lit(0)) <= 0, simple(new)).otherwise(once(both, merged))


def citation_key(url: Column, id_key: str | None = None) -> Column:
    """What is equal for equivalent addresses: the host and content id where a site has such ids, else the normalised address."""
    plain = urls.normalize(url)
    if id_key is None:
        return plain
    content = urls.parameter(url, id_key)
    return F.when(content.isNotNull(), F.concat_ws("\x1f", urls.host(url), F.lit(id_key), content)).otherwise(plain)


def citations(published: DataFrame, incoming: DataFrame, key: str, source: str, url: str, checked: str, external: str, order: Sequence[str] = (), id_key: str | None = None) -> DataFrame:
    """(key, source, url, checked, external): citations by key, source and equivalent address. The address is the published one (else the first that came in, by ``order`` or itself), the rest what was told last."""
    names = [key, source, url, checked, external]
    told = published.select(*names, F.lit(0).alias("_new"), *order).unionByName(incoming.select(*names, F.lit(1).alias("_new"), *order))
    first, last = F.struct("_new", *order, url), F.struct("_new", *order, checked)
    known = lambda c: F.max_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", last))
    out = told.withColumn("_same", citation_key(F.col(url), id_key)).groupBy(key, source, "_same").agg(F.min_by(url, first).alias(url), known(checked).alias(checked), known(external).alias(external))
    return out.select(*names)
