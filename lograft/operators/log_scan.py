"""Failure labels and URLs in log files on storage, whatever their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.constants import GIST, REPO
from lograft.functions.text import js_trim
from lograft.functions.urls import found_gist_url, found_repository_url
from lograft.operators.audit import HIDDEN
from lograft.operators.catalogue import scan_log_files
from lograft.operators.failures import LABELS, classify_failures
from lograft.sources.catalogue import plain_path, plain_root, qualified


def log_lines(
    spark: SparkSession, root: str, suffixes: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """The lines of all files below ``root``: path, line, and ``at``, by which the lines of a file are ordered.

    Files are read in byte ranges; the task whose range a line begins in reads it to its end, so a line that
    crosses a border is there once and whole. Files that Spark takes for hidden are left out.
    """
    root = qualified(spark, root)
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    at = F.struct(F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"))
    lines = reader.text(root).select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("line"), at.alias("at"))
    start = len(plain_root(root)) + 2
    for fragment in exclude:
        lines = lines.where(~F.substring("path", start, 1 << 30).contains(fragment))
    return lines


def _visible_files(spark: SparkSession, root: str, suffixes: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    files = scan_log_files(spark, root, suffixes, exclude)
    return files.where(~F.col("relative_path").rlike(HIDDEN)).select("path", "size_bytes")


def _first(condition: Column, value: Column) -> Column:
    """The value of the first line of the file for which the condition holds."""
    return F.min(F.when(condition, F.struct("at", value.alias("value"))))["value"]


def scan_failures(
    spark: SparkSession, root: str, suffixes: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """What the files below ``root`` say of failures, as if each were one attempt's error output; a row a file.

    Columns: path, size_bytes, the labels of :func:`classify_failures` (none of whose phrases holds a line end),
    ``n_failures`` (lines with a label), ``first_failure`` (the first of these, trimmed), and ``repository_url``, the first line
    that is a repository URL and nothing else. Only lines with something found are shuffled, and combined before.
    Empty files have no labels.
    """
    none = F.lit(None).cast("string")
    lines = log_lines(spark, root, suffixes, exclude).withColumns(
        {"stderr": F.col("line"), "stdout": none, "message": none, "error_code": none, "exit_code": F.lit(0)}
    )
    labelled = classify_failures(lines).withColumn("url", found_repository_url(F.col("line")))
    failed = F.greatest(*(F.col(label) for label in LABELS))
    found = (
        labelled.where(failed | F.col("url").isNotNull())
        .groupBy("path")
        .agg(
            *(F.bool_or(label).alias(label) for label in LABELS),
            F.count_if(failed).alias("n_failures"),
            _first(failed, js_trim(F.col("line"))).alias("first_failure"),
            _first(F.col("url").isNotNull(), F.col("url")).alias("repository_url"),
        )
    )
    joined = _visible_files(spark, root, suffixes, exclude).join(found, "path", "left")
    return joined.select(
        "path",
        "size_bytes",
        *(F.coalesce(label, F.lit(False)).alias(label) for label in LABELS),
        F.coalesce("n_failures", F.lit(0)).cast("bigint").alias("n_failures"),
        "first_failure",
        "repository_url",
    )


def scan_url_targets(
    spark: SparkSession, root: str, suffixes: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """How often each URL stands alone on a line of the files below ``root``, by kind; counted before the shuffle."""
    line = F.col("line")
    found = log_lines(spark, root, suffixes, exclude).select(
        F.explode(
            F.array(
                F.struct(F.lit(REPO).alias("kind"), found_repository_url(line).alias("url")),
                F.struct(F.lit(GIST).alias("kind"), found_gist_url(line).alias("url")),
            )
        ).alias("t")
    )
    return found.where("t.url IS NOT NULL").groupBy("t.kind", "t.url").agg(F.count("*").alias("uses"))
