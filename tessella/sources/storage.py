"""Reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(spark: SparkSession) -> str:
    """A folder of this machine, which will do only where driver and executors are one process."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder, or a local one where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or _own_folder(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the cluster's shared checkpoint folder and reads it from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset (tests
    on one machine) a folder of our own is set. Files survive the loss of executors.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_own_folder(spark))
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like cut, as compressed columns: a small part of a checkpoint's disk where rows repeat names or are read by some of their columns."""
    path = shared_folder(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch of rows on its way to Python and back, of which a task holds several.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches have ``BATCH_BYTES`` at most, so that rows of long texts don't fill an executor."""
    conf = df.sparkSession.conf
    if int(conf.get(_BATCHES, str(64 << 20))) > BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def parts_for(df: DataFrame, rows_a_task: int = 400_000) -> int:
    """Partitions for a pass over as many rows as ``df`` has: the session's number, or more where a task would get over ``rows_a_task``.
    ``df`` is a plain table, whose rows are counted from its files' footers."""
    return max(tasks(df), 1 + df.count() // rows_a_task)


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df dealt by ``keys`` into ``parts`` partitions (0: as the session would)."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def settled(df: DataFrame, rows_a_task: int = 50_000) -> tuple[DataFrame, int]:
    """cut(df) with as many partitions as its rows ask for, and the number of rows."""
    df = cut(df)
    rows = df.count()
    return df.coalesce(1 + rows // rows_a_task), rows
