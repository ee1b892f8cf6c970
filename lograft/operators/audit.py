"""Line-limit audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.constants import AUDIT_EXCLUDES, AUDIT_MAX_LINES, AUDIT_SUFFIXES
from lograft.operators.catalogue import scan_log_files
from lograft.operators.chunks import chunk_manifest
from lograft.sources.bytechunks import with_range_content
from lograft.sources.catalogue import plain_path, plain_root, qualified

# What Spark's file sources skip: names that start with "." or "_", and copies in progress.
HIDDEN = r"(?:\A|/)[._]|\._COPYING_\z"
_REPORT = ("path", "relative_path", "size_bytes")


def _newlines(text: Column) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint")


def count_lines(
    spark: SparkSession,
    root: str,
    suffixes: Sequence[str] = AUDIT_SUFFIXES,
    exclude: Sequence[str] = AUDIT_EXCLUDES,
) -> DataFrame:
    """Lines per file below ``root``: newlines + 1, also for an empty file.

    Files are read as splittable text, so one huge file is many tasks; only
    counters are shuffled. A record is a stretch up to a newline; whether the
    last one had its newline shows in the byte count. The reader drops a leading
    byte order mark, hence the two values that mean "ended with a newline".
    Files that the text reader takes for hidden are read as byte ranges instead.
    """
    root = qualified(spark, root)
    catalogue = scan_log_files(spark, root, suffixes, exclude)
    hidden = F.col("relative_path").rlike(HIDDEN)
    return _visible_lines(spark, root, suffixes, exclude, catalogue.where(~hidden)).unionByName(
        _hidden_lines(catalogue.where(hidden))
    )


def _visible_lines(
    spark: SparkSession, root: str, suffixes: Sequence[str], exclude: Sequence[str], catalogue: DataFrame
) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    path = plain_path(F.col("_metadata.file_path"))
    text = reader.text(root)
    start = len(plain_root(root)) + 2
    for fragment in exclude:
        text = text.where(~F.substring(path, start, 1 << 30).contains(fragment))
    counted = text.groupBy(path.alias("path")).agg(
        F.count("*").alias("records"), F.sum(F.octet_length("value") + F.lit(1)).alias("_bytes")
    )
    closed = (F.col("size_bytes") - F.col("_bytes")).isin(0, 3)
    lines = F.when(F.col("records").isNull(), F.lit(1)).otherwise(
        F.col("records") + F.when(closed, F.lit(1)).otherwise(F.lit(0))
    )
    return catalogue.join(counted, "path", "left").select(*_REPORT, lines.cast("bigint").alias("lines"))


def _hidden_lines(catalogue: DataFrame) -> DataFrame:
    ranges = chunk_manifest(catalogue.select(*_REPORT))
    return (
        with_range_content(ranges)
        .groupBy(*_REPORT)
        .agg((F.sum(_newlines(F.col("content").cast("string"))) + 1).alias("lines"))
    )


def line_limit_report(
    spark: SparkSession,
    root: str,
    max_lines: int = AUDIT_MAX_LINES,
    suffixes: Sequence[str] = AUDIT_SUFFIXES,
    exclude: Sequence[str] = AUDIT_EXCLUDES,
) -> DataFrame:
    """Files with more than ``max_lines`` lines."""
    return count_lines(spark, root, suffixes, exclude).where(F.col("lines") > max_lines)


def body_line_report(bodies: DataFrame, max_lines: int = AUDIT_MAX_LINES) -> DataFrame:
    """The same audit for texts that are already a ``text`` column; narrow."""
    return bodies.withColumn("lines", _newlines(F.col("text")) + 1).where(F.col("lines") > max_lines)
