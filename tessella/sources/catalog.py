"""The JSON catalogue: explicit schemas, strict keys, file name checks, versioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_NAMED = "schemaVersion int, id string, slug string, name string"
SCHEMAS = {
    "events": "schemaVersion int, id string, slug string, slugAliases array<string>, title string, status string, venueId string, organizerIds array<string>, seriesId string, "
    "occurrences array<struct<id:string,date:string,time:string,status:string>>, performers array<struct<name:string,role:string>>, composers array<struct<name:string>>, "
    "works array<struct<title:string,composerName:string>>, eras array<string>, formats array<string>, kind string, access string, "
    "citations array<struct<sourceId:string,url:string,checkedAt:string,externalId:string>>, primarySourceId string, lastVerifiedAt string",
    "venues": f"{_NAMED}, municipality string, area string, address string, url string, lastVerifiedAt string, parentVenueId string, spaceName string",
    "organizers": f"{_NAMED}, url string",
    "series": f"{_NAMED}, kind string, url string",
    "sources": f"{_NAMED}, kind string, url string",
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A folder of one-entity JSON files, with ``_file`` and ``_unknown`` (top-level keys that the schema lacks) and ``_corrupt``."""
    schema = StructType.fromDDL(SCHEMAS[name])
    raw = spark.read.text(f"{root}/{name}", wholetext=True).select("value", F.col("_metadata.file_name").alias("_file"))
    row = F.from_json("value", schema)
    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*map(F.lit, schema.names)))
    return raw.select(row.alias("row"), "_file", unknown.alias("_unknown"), F.json_object_keys("value").isNull().alias("_corrupt")).select("row.*", "_file", "_unknown", "_corrupt")


def issues(entities: DataFrame) -> DataFrame:
    """(code, severity, path, message) of unreadable files, unknown keys, and names that are not the id's."""
    checks = {
        "invalid-json": (F.col("_corrupt"), F.lit("not a JSON object")),
        "schema": (~F.col("_corrupt") & ((F.size("_unknown") > 0) | ~F.coalesce(F.col("schemaVersion") == 1, F.lit(False))), F.array_join("_unknown", ",")),
        "filename-id-mismatch": (~F.col("_corrupt") & ~F.concat("id", F.lit(".json")).eqNullSafe(F.col("_file")), F.col("id")),
    }
    found = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit("error").alias("severity"), F.col("_file").alias("path"), m.alias("message"))) for code, (c, m) in checks.items())))
    return entities.select(F.explode(found).alias("i")).select("i.*")


class InvalidCatalogue(ValueError):
    """A catalogue that can't be used; ``findings`` has all of them."""

    def __init__(self, findings: DataFrame, shown: int = 100):
        some, many = findings.limit(shown).collect(), findings.count()
        told = "; ".join(f"{r['path']}: {r['code']} {r['message'] or ''}".strip() for r in some)
        super().__init__(f"{many} findings: {told}" + f"; and {many - len(some)} more in findings" * (many > len(some)))
        self.findings = findings


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All five tables; raises InvalidCatalogue, which has the findings, if anything is wrong."""
    tables = {name: read(spark, root, name) for name in SCHEMAS}
    found = None
    for df in tables.values():
        found = issues(df) if found is None else found.union(issues(df))
    if not found.isEmpty():
        raise InvalidCatalogue(found)
    return {name: df.drop("_file", "_unknown", "_corrupt") for name, df in tables.items()}


def write(df: DataFrame, path: str, version: str) -> str:
    """A new version's folder; readers follow the version that they are told, so a failed write leaves the old one whole."""
    target = f"{path.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(target)
    return target
