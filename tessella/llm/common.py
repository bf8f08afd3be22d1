"""What the operators share: reading tables, cutting lineage safely, and sending texts to Python once."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.sources.storage import cut, settled, shared_folder, small_batches, table, tasks

__all__ = ["beside_text", "cut", "discard", "settled", "shared_folder", "small_batches", "stored", "table", "tasks", "whole_row"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to a new path in the cluster's shared folder, and read from there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of what ``stored`` gave, once nothing reads them any more."""
    jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _aside(docs: DataFrame, keep: Sequence[str], text_col: str) -> bool:
    return text_col in keep and isinstance(docs.schema[text_col].dataType, StringType)


def beside_text(docs: DataFrame, keep: Sequence[str], text_col: str) -> Column:
    """The struct ``row`` of columns ``keep``, but for the text itself, which goes beside it and need not go twice."""
    return F.struct(*(F.col(f"`{c}`") for c in keep if not (c == text_col and _aside(docs, keep, text_col))), F.lit(0).alias("_")).alias("row")


def whole_row(docs: DataFrame, keep: Sequence[str], text_col: str, row: str = "row", text: str = "text") -> Column:
    """The struct ``row`` of columns ``keep``, put together from what ``beside_text`` gave and the text."""
    aside = _aside(docs, keep, text_col)
    return F.struct(*((F.col(text) if aside and c == text_col else F.col(row)[c]).alias(c) for c in keep)).alias("row")
