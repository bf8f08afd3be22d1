"""What a run leaves behind: canonical JSON, versions with a pointer, a journal of runs, reports, and batches of outside observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import catalog

#: A batch of observations from outside: one JSON document.
BATCH = (
    "schemaVersion int, observations array<struct<source:struct<url:string,name:string,kind:string>,event:struct<title:string,externalId:string,occurrences:array<struct<date:string,time:string>>>,"
    "venue:struct<name:string,municipality:string,area:string,address:string>,foundVia:string>>, windowMonthsSearched array<string>"
)


def ordered(column: Column, kind) -> Column:
    """The same value with the fields of every struct in order of their names."""
    if isinstance(kind, StructType):
        fields = F.struct(*(ordered(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
        return F.when(column.isNotNull(), fields)
    if isinstance(kind, ArrayType):
        return F.transform(column, lambda x: ordered(x, kind.elementType))
    return column


def canonical(df: DataFrame) -> DataFrame:
    """(json): each row as JSON with keys in order at every depth and nulls left out, so that equal rows are equal texts."""
    columns = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(F.to_json(F.struct(*(ordered(F.col(f.name), f.dataType).alias(f.name) for f in columns))).alias("json"))


_VERSIONS = "version string, number long, at long"


def _versions(spark: SparkSession, base: str) -> DataFrame:
    """Versions that were published, with the order in which they were; none if nothing was."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/versions")
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(_VERSIONS).json(f"{base}/versions") if there else spark.createDataFrame([], _VERSIONS)


def publish(df: DataFrame, path: str, version: str) -> str:
    """Writes a version, then lets the pointer follow: readers see the old version until the new one is whole. Versions are numbered as
    they are published; of two that writers publish at once, that with the later clock (microseconds) counts."""
    target, spark, base = catalog.write(df, path, version), df.sparkSession, path.rstrip("/")
    number = (_versions(spark, base).agg(F.max("number")).first()[0] or 0) + 1
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit(number).cast("long").alias("number"), F.unix_micros(F.current_timestamp()).alias("at"))
    row.coalesce(1).write.mode("append").json(f"{base}/versions")
    return target


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The version that was published last."""
    base = path.rstrip("/")
    version = _versions(spark, base).agg(F.max_by("version", F.struct("number", "at", "version"))).first()[0]
    return spark.read.schema(schema).json(f"{base}/version={version}")


def record(run: dict[str, str | int], counts: DataFrame, path: str) -> None:
    """Adds a run to the journal: its facts and a row a counter."""
    facts = [F.lit(v).alias(k) for k, v in sorted(run.items())]
    counts.select(*facts, *counts.columns).write.mode("append").json(path)


def report(issues: DataFrame, path: str) -> None:
    """The findings by code, errors first, as JSON lines."""
    issues.orderBy((F.col("severity") != "error"), "code", "path").write.mode("errorifexists").json(path)


def observations(spark: SparkSession, path: str) -> DataFrame:
    """The observations of outside batches, with their file and place; ``problem`` says what a batch lacks."""
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    batch = raw.select("file", F.from_json("value", BATCH).alias("b"), F.json_object_keys("value").alias("keys"))
    problem = F.when(F.col("keys").isNull(), "invalid-json").when(~F.coalesce(F.col("b.schemaVersion") == 1, F.lit(False)), "schema").when(F.coalesce(F.size("b.observations"), F.lit(-1)) <= 0, "empty")
    rows = batch.select("file", problem.alias("problem"), F.posexplode_outer("b.observations").alias("place", "o"))
    return rows.select("file", "problem", "place", "o.*")


def months_searched(spark: SparkSession, path: str) -> DataFrame:
    """(month, files): the months that outside batches say were searched."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(F.from_json("value", BATCH)["windowMonthsSearched"]).alias("month"))
    return raw.groupBy("month").agg(F.countDistinct("file").alias("files"))


class Memo:
    """Tables by name, each read once a session and kept by Spark until it is dropped."""

    def __init__(self, spark: SparkSession, root: str, names: Sequence[str] = tuple(catalog.SCHEMAS)):
        self.spark, self.root, self.names, self._held = spark, root, names, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name not in self._held:
            self._held[name] = catalog.read(self.spark, self.root, name).persist()
        return self._held[name]

    def drop(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()
