"""Session helpers: a tuned local session for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(
    cores: int | str = 8, app: str = "lograft", memory: str = "8g", shared: str | None = None
) -> SparkSession:
    """A ``local[cores]`` session with the settings a cluster job would also want.

    ``shared`` names the folder for derived tables; a single machine may use a new
    temporary one, as every executor thread sees it.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="lograft-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Above 8000 bytes the JVM never compiles a method; smaller methods beat one big one.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for derived data under the shared folder."""
    return os.path.join(shared_folder(spark), "lograft", f"{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    This cuts the lineage, survives lost executors, and lets each reader prune
    columns and plan with true sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, size_column: str, task_bytes: int, *keys: str) -> DataFrame:
    """Deal out small rows that stand for ``size_column`` bytes of work each.

    The number of partitions comes from the total work, in one cheap pass over
    the rows, which are stored so that what makes them runs once. It has to be given: left to itself, adaptive execution would merge
    partitions by the size of the rows, and one task would get all the work.
    """
    spark = rows.sparkSession
    rows = stored(rows, "spread")
    total = rows.agg(F.sum(size_column)).first()[0] or 0
    partitions = max(spark.sparkContext.defaultParallelism, -(-int(total) // task_bytes))
    return rows.repartition(partitions, *keys)
