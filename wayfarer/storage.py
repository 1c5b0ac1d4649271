"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a partition of ``spread``.
ROWS_OF_TASK = 1 << 18


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Rows of a table in as many partitions of ``keys`` as its size asks for, so that what a task sorts grows no further; small ones stay as they are.  ``rows``: how many they are, if known."""
    tasks = (df.count() if rows is None else rows) // ROWS_OF_TASK + 1
    return df if tasks <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(tasks, *keys)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="wayfarer-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows written and read back: loops call it every round, so that plans don't grow and executors may fail."""
    return keep(df, "round")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"


def keep_path(df: DataFrame, name: str) -> str:
    """Writes a table in the shared folder and returns its path."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Written as a table in the shared folder and read back."""
    path = keep_path(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """Written as a table in buckets of ``key``, sorted by it, so that joins on ``key`` shuffle only their other side."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, path = f"wayfarer_{name}_{uuid.uuid4().hex}", f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
