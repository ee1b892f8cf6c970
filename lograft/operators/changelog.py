"""Changelogs cut into versions, and new entries put on top."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lograft.functions.text import LINE_END, LINE_START, drop_first, first_non_empty, js_trim

# The line end before a heading, on a body with one more in front: far cheaper than a place between two characters.
_SECTION_SPLIT = rf"[{LINE_END}](?=## \d)"
_SECTION_HEAD = r"\A## (\d\S*)"
_ENTRY_HEAD = rf"{LINE_START}## "
# A version with one of these is a pattern of its own, or none.
_ODD = r"[()\[\]{}\\*+?|^$]"
# What is a pattern to one engine but not to another, or means something else there.
_UNCOMMON = re.compile(r"\(\?(?!:|=|!|<=|<!)|[*+?}][*+]|\[[^\]]*(?:\[|&&)|\{(?!\d+(?:,\d*)?\})")
_NEVER = "(?!)"
_TITLE = rf"{LINE_START}# [^{LINE_END}]+"


def explode_changelog(changelogs: DataFrame) -> DataFrame:
    """One row per version section: position, version and trimmed body; narrow."""
    keep = [c for c in changelogs.columns if c != "body"]
    parts = F.split(F.concat(F.lit("\n"), "body"), _SECTION_SPLIT, -1)
    sections = F.filter(parts, lambda part: part.rlike(_SECTION_HEAD))
    return (
        changelogs.select(*keep, F.posexplode(sections).alias("_at", "_part"))
        .withColumn("version", F.regexp_extract("_part", _SECTION_HEAD, 1))
        .select(
            *keep,
            F.col("_at").cast("bigint").alias("position"),
            "version",
            js_trim(F.substring(F.col("_part"), F.length("version") + 4, F.length("_part"))).alias("section"),
        )
    )


def is_pattern(version: str) -> bool:
    """Whether a version can be searched for as a pattern."""
    if _UNCOMMON.search(version):
        return False
    try:
        re.compile(version)
    except re.error:
        return False
    return True


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        judged = [is_pattern(v) for v in batch.column("version").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("version"), pa.array(judged)], names=["version", "_pattern"])


def _judged(versions: DataFrame) -> DataFrame:
    """Adds ``_pattern``: each different odd version is tried once; the others are patterns."""
    odd = versions.select("version").where(F.col("version").rlike(_ODD)).distinct()
    odd = odd.mapInArrow(_judge, "version string, _pattern boolean")
    return versions.join(odd, "version", "left")


def _legacy_section(body: Column, version: Column) -> Column:
    asked = F.concat(F.lit("## "), version, F.lit(r"[\s\S]*?(?=## \d|\z)"))
    pattern = F.when(F.coalesce("_pattern", F.lit(True)), asked).otherwise(F.lit(_NEVER))
    found = F.call_function("regexp_extract", body, pattern, F.lit(0))
    return js_trim(drop_first(found, F.concat(F.lit("## "), version)))


def release_notes(
    changelogs: DataFrame, versions: DataFrame, key: str = "doc_id", legacy: bool = False
) -> DataFrame:
    """Notes for each wanted ``(key, version)``; ``Release <version>`` if there are none.

    ``legacy`` takes the version as a pattern that may match anywhere, so that
    ``1.2`` also finds ``## 1.20`` when that comes first, and ``1.2(-rc)?`` both; one that is no pattern
    finds nothing. The exact form joins the
    exploded sections; of repeated versions the first counts.
    """
    if legacy:
        notes = _judged(versions).join(changelogs, key, "left").withColumn(
            "section", _legacy_section(F.col("body"), F.col("version"))
        )
    else:
        sections = (
            explode_changelog(changelogs)
            .groupBy(key, "version")
            .agg(F.min_by("section", "position").alias("section"))
        )
        notes = versions.join(sections, [key, "version"], "left")
    fallback = F.concat(F.lit("Release "), F.col("version"))
    return notes.select(key, "version", first_non_empty(F.col("section"), fallback).alias("notes"))


def prepend_entries(changelogs: DataFrame) -> DataFrame:
    """Put an entry for ``version``, ``bump``, ``description`` on top of each ``body``.

    It goes before the first version heading, else behind the title, else first.
    """
    body = F.col("body")
    described = first_non_empty(
        F.col("description"), F.concat(F.lit("Manual "), F.col("bump"), F.lit(" release"))
    )
    entry = F.concat(
        F.lit("## "), F.col("version"), F.lit("\n\n### "), F.initcap("bump"), F.lit(" Changes\n\n- "), described, F.lit("\n\n")
    )
    heading = F.regexp_instr(body, F.lit(_ENTRY_HEAD))
    title = F.regexp_extract(body, _TITLE, 0)
    behind = F.regexp_instr(body, F.lit(_TITLE)) + F.length(title)

    def cut(at: Column, *middle: Column) -> Column:
        head = F.substring(body, F.lit(1), at - 1)
        return F.concat(head, *middle, F.substring(body, at, F.length(body)))

    return changelogs.withColumn(
        "body",
        F.when(heading > 0, cut(heading, entry))
        .when(title != "", cut(behind, F.lit("\n\n"), entry))
        .otherwise(F.concat(entry, F.lit("\n"), body)),
    ).drop("version", "bump", "description")
