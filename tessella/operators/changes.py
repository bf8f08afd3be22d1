"""What differs between two versions of a table, at any depth.

The tables' schema drives a walk over structs, arrays and maps that is one expression a row: no row leaves the engine's own code, and rows meet in one join on their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_FOUND = "array<struct<path:string,before:string,after:string>>"


def _none() -> Column:
    return F.array().cast(_FOUND)


def _leaf(value: Column, kind: DataType) -> Column:
    return F.when(value.isNotNull(), F.to_json(value) if isinstance(kind, (StructType, ArrayType, MapType)) else value.cast("string"))


def _walk(a: Column, b: Column, kind: DataType, path: Column) -> Column:
    """The differences of two values of one type below a path. Where one side is missing altogether, that is one difference."""
    one = F.array(F.struct(path.alias("path"), _leaf(a, kind).alias("before"), _leaf(b, kind).alias("after")))
    if isinstance(kind, StructType):
        each = [_walk(a[f.name], b[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        deep = F.concat(*each) if each else _none()
    elif isinstance(kind, ArrayType):
        places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
        at = lambda side, i: F.get(side, i)
        deep = F.when(F.greatest(F.size(a), F.size(b)) > 0, F.flatten(F.transform(places, lambda i: _walk(at(a, i), at(b, i), kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))).otherwise(_none())
    elif isinstance(kind, MapType):
        keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))
        deep = F.flatten(F.transform(keys, lambda k: _walk(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, F.concat(path, F.lit("{"), k.cast("string"), F.lit("}")))))
    else:
        return F.when(a.eqNullSafe(b), _none()).otherwise(one)
    return F.when(a.isNull() & b.isNull(), _none()).when(a.isNull() | b.isNull(), one).otherwise(deep)


def differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, path, before, after): a row for each value that differs between the versions' rows of a key.

    Paths are like ``lines[2].price``; values are texts, whole structs and lists JSON. A key that only one version has gives one row with an empty path and the whole row on its side. Keys are
    unique in each version; rows with a null key are left out. Columns that only one version has are null in the other; equal names have equal types.
    """
    names = [c for c in dict.fromkeys([*before.columns, *after.columns]) if c != key]
    kinds = {f.name: f.dataType for f in [*before.schema.fields, *after.schema.fields]}
    side = lambda df, tag: df.where(F.col(key).isNotNull()).select(F.col(key), F.struct(*((F.col(c) if c in df.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names)).alias(tag))
    both = side(before, "_a").join(side(after, "_b"), key, "full_outer")
    whole = F.array(F.struct(F.lit("").alias("path"), F.to_json("_a").alias("before"), F.to_json("_b").alias("after")))
    fields = [_walk(F.col(f"_a.{c}"), F.col(f"_b.{c}"), kinds[c], F.lit(c)) for c in names]
    found = F.when(F.col("_a").isNull() | F.col("_b").isNull(), whole).otherwise(F.concat(*fields) if fields else _none())
    return both.select(key, F.explode(found).alias("d")).select(key, "d.path", "d.before", "d.after")


def summary(found: DataFrame) -> DataFrame:
    """(path, n): how many differences there are at each path, with places in lists left out."""
    return found.groupBy(F.regexp_replace("path", r"\[[0-9]+\]|\{[^}]*\}", "[]").alias("path")).agg(F.count(F.lit(1)).alias("n"))
