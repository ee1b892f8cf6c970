"""Synthetic log corpora of given sizes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.constants import CONSTANT_LINE, LINE_MARK, MIB, NUMBERED_LINE
from lograft.functions.sizes import ceil_div
from lograft.session import spread

BLOCK = 1 << 16
TASK_BYTES = 256 * MIB


def corpus_lines(sizes: DataFrame, template: str = NUMBERED_LINE) -> DataFrame:
    """Lines for each row of ``sizes`` (which has a ``target_bytes`` column).

    The number of lines counts the template with its mark still in place, so the
    result only comes near the target. ``line`` is without its newline, as a text
    sink adds it. Lines are made in blocks that are dealt out over all tasks, so
    one huge size is no heavier for a task than many small ones.
    """
    blocks = (
        sizes.withColumn("n_lines", ceil_div(F.col("target_bytes"), len(template)))
        .where("n_lines > 0")
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), ceil_div(F.col("n_lines"), BLOCK) - 1)))
    )
    first = F.col("_block") * BLOCK + 1
    last = F.least(first + (BLOCK - 1), F.col("n_lines"))
    sized = blocks.withColumn("_work", (last - first + 1) * len(template))
    dealt = spread(sized, "_work", TASK_BYTES, "_block", *sizes.columns)
    text = template.removesuffix("\n")
    return (
        dealt.withColumn("line_no", F.explode(F.sequence(first, last)))
        .drop("_block", "_work", "n_lines")
        .withColumn("line", F.replace(F.lit(text), F.lit(LINE_MARK), F.col("line_no").cast("string")))
    )


def generate_log_corpus(
    spark: SparkSession, sizes_mb: Iterable[int], template: str | None = None, numbered: bool = True
) -> DataFrame:
    """``(target_mb, line_no, line)`` for each target size in MiB."""
    template = template or (NUMBERED_LINE if numbered else CONSTANT_LINE)
    sizes = spark.createDataFrame([(int(mb),) for mb in sizes_mb], "target_mb bigint")
    return corpus_lines(sizes.withColumn("target_bytes", F.col("target_mb") * MIB), template).drop("target_bytes")


def corpus_summary(lines: DataFrame, *keys: str) -> DataFrame:
    """Line count and bytes (newlines included) per corpus file."""
    return lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.sum(F.octet_length("line") + 1).alias("bytes")
    )


def bytes_before(lines: Column, template: str) -> Column:
    """The bytes of that many first lines, in closed form: what is fixed in each, and the digits of their numbers."""
    marks = template.count(LINE_MARK)
    fixed = len(template.encode()) - marks * len(LINE_MARK)
    width = F.length(lines.cast("string"))
    # Of the numbers 1 to n, all have a digit, all from 10 a second, all from 100 a third.
    ones = F.repeat(F.lit("1"), width).cast("bigint")
    digits = F.when(lines > 0, width * (lines + 1) - ones).otherwise(F.lit(0))
    return lines * fixed + digits * marks


def corpus_parts(sizes: DataFrame, template: str = NUMBERED_LINE, part_lines: int = BLOCK) -> DataFrame:
    """The parts of each corpus file: ``part``, its ``first_line`` and ``last_line``, its ``offset`` and ``length`` in bytes.

    No part needs to know any other. A target of 0 has no parts.
    """
    lines = sizes.withColumn("_lines", ceil_div(F.col("target_bytes"), len(template))).where("_lines > 0")
    parts = lines.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), ceil_div(F.col("_lines"), part_lines) - 1)))
    placed = parts.withColumns(
        {
            "first_line": F.col("part") * part_lines + 1,
            "last_line": F.least((F.col("part") + 1) * part_lines, F.col("_lines")),
        }
    ).drop("_lines")
    start = bytes_before(F.col("first_line") - 1, template)
    return placed.withColumns({"offset": start, "length": bytes_before(F.col("last_line"), template) - start})


def write_corpus_files(
    sizes: DataFrame, root: str, file_column: str, template: str = NUMBERED_LINE, part_lines: int = BLOCK
) -> DataFrame:
    """Write each corpus as ``<file_column>=<file>/part=<n>/`` under ``root``; returns its :func:`corpus_parts`.

    A part is one file of exactly its ``length``; a corpus is its parts one after another, byte for byte, so any
    number of tasks write one file of any size. The template has to end with a newline. A part that a lost
    executor was writing is written again, and counts once the job is committed.
    """
    if not template.endswith("\n") or "\n" in template[:-1]:
        raise ValueError("the template has to be one line with its newline")
    parts = corpus_parts(sizes, template, part_lines)
    dealt = spread(parts, "length", TASK_BYTES, file_column, "part")
    line = F.replace(F.lit(template[:-1]), F.lit(LINE_MARK), F.col("_line").cast("string"))
    lines = (
        dealt.sortWithinPartitions(file_column, "part")
        .withColumn("_line", F.explode(F.sequence("first_line", "last_line")))
        .select(file_column, "part", line.alias("value"))
    )
    lines.write.partitionBy(file_column, "part").text(root)
    return parts
