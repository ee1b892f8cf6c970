"""Catalogue of log files, and requests whose file is not in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lograft.functions.text import first_non_empty
from lograft.sources.catalogue import FileCatalogue, qualified


def scan_log_files(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = (),
    exclude: Sequence[str] = (),
    include_dotfiles: bool = True,
    prefix: str = "",
    min_bytes: int | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Regular files below ``root`` with their sizes; file bodies are not opened.

    ``exclude`` drops every file whose path relative to ``root`` contains one of
    the fragments. Zero-byte files are kept. All limits are judged while listing;
    directories that cannot hold a relative path that begins with ``prefix`` are not opened.
    """
    reader = _with_options(spark, spark.read, suffixes, exclude)
    for option, value in (("prefix", prefix), ("minBytes", min_bytes), ("maxBytes", max_bytes)):
        if value not in (None, ""):
            reader = reader.option(option, value)
    files = reader.load(qualified(spark, root))
    return files if include_dotfiles else files.where(~F.col("name").startswith("."))


def _with_options(spark: SparkSession, reader, suffixes: Sequence[str], exclude: Sequence[str]):
    spark.dataSource.register(FileCatalogue)
    tasks = max(64, 4 * spark.sparkContext.defaultParallelism)
    reader = reader.format(FileCatalogue.name()).option("fanOut", tasks)
    for option, values in (("suffixes", suffixes), ("exclude", exclude)):
        if values:
            reader = reader.option(option, "\n".join(values))
    return reader


def stream_log_files(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = (),
    exclude: Sequence[str] = (),
    lateness_seconds: float = 3600,
    settle_seconds: float = 0,
) -> DataFrame:
    """New and changed files below ``root`` as a stream, empty ones included; a file may come more than once.

    A file whose time is older than what has been read comes with the next batch if it is late by no more than
    ``lateness_seconds``, else with the next full listing (each run begins with one).
    """
    reader = _with_options(spark, spark.readStream, suffixes, exclude)
    reader = reader.option("lateness", lateness_seconds).option("settle", settle_seconds)
    return reader.load(qualified(spark, root))


def missing_inputs(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests that name a path which the catalogue does not have."""
    return (
        requests.where(first_non_empty(F.col("path")).isNotNull())
        .join(files.select("path"), "path", "left_anti")
        .select(
            "request_id",
            "path",
            F.concat(F.lit("File does not exist: "), F.col("path")).alias("error"),
        )
    )
