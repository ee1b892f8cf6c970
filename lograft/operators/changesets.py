"""Change records: parsing, merging per release batch, and the per-PR gate."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import CHANGESET_PREFIX, CHANGESET_README, CHANGESET_SUFFIX
from lograft.functions.text import LINE_START, WS, js_trim
from lograft.operators.joins import left_join_present

# --- Fixed values: bumps by rank ---------------------------------------------
BUMPS = ("patch", "minor", "major")
DEFAULT_BUMP = "patch"
MARKER = "---"
RECORD_HEAD = "---\n'{package}': "
RECORD_MIDDLE = "\n---\n\n"


def bump_of(content: Column, package: str, quoted: bool) -> Column:
    """The bump named for ``package``, or NULL.

    ``quoted`` demands quotes around the package; otherwise they are optional.
    """
    quote = "['\"]" if quoted else "['\"]?"
    pattern = f"{LINE_START}{quote}{re.escape(package)}{quote}:[{WS}]+(major|minor|patch)"
    return F.nullif(F.regexp_extract(content, pattern, 1), F.lit(""))


def _sections(content: Column) -> Column:
    return F.split(content, MARKER, -1)


def description_of(content: Column) -> Column:
    """Text behind the second marker; later markers belong to it."""
    parts = _sections(content)
    body = F.array_join(F.slice(parts, F.lit(3), F.size(parts)), MARKER)
    return F.when(F.size(parts) >= 3, js_trim(body)).otherwise(F.lit(""))


def parse_changesets(df: DataFrame, package: str, strict: bool = False) -> DataFrame:
    """Add ``bump`` (NULL when unparseable) and ``description``; narrow."""
    bump = bump_of(F.col("content"), package, strict)
    return df.withColumns(
        {"bump": bump, "description": F.when(bump.isNotNull(), description_of(F.col("content")))}
    ).drop("content")


def _batches(parsed: DataFrame, batch: str) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, BUMPS)), F.col("bump"))
    described = F.col("description") != ""
    return (
        parsed.groupBy(batch)
        .agg(
            F.count("*").alias("n_files"),
            F.count("bump").alias("n_parsed"),
            F.count_if(described).alias("n_descriptions"),
            F.coalesce(F.sum(F.octet_length("description")), F.lit(0)).alias("body_bytes"),
            F.max(rank).alias("_rank"),
            F.min(F.when(described, F.struct("mtime", "file"))).alias("_first"),
        )
        .withColumns(
            {
                "action": F.when(F.col("n_files") < 2, "none")
                .when(F.col("n_parsed") == 0, "error")
                .otherwise("merged"),
                "bump": F.coalesce(
                    F.get(F.array(*map(F.lit, BUMPS)), (F.col("_rank") - 1).cast("int")), F.lit(DEFAULT_BUMP)
                ),
            }
        )
        .drop("_rank")
    )


def merge_changesets(df: DataFrame, package: str, batch: str = "batch") -> DataFrame:
    """One row per batch: highest bump and counts; ``merged_entries`` has the record's text.

    ``action`` is ``none`` for a single file, ``error`` when no file of several
    can be parsed, else ``merged``. Unparseable files count as files. All is
    counts and a max, combined before the shuffle.
    """
    return _batches(parse_changesets(df, package), batch).drop("_first")


def merged_entries(df: DataFrame, package: str, batch: str = "batch") -> DataFrame:
    """The merged records in pieces: read by (``piece``, ``mtime``, ``file``), their ``text`` is the record.

    Piece 0 is the head with the bump, piece 1 stands for each description (with the
    blank line before it, unless it is the first), piece 2 is the end. A batch of any size is rows, so
    nothing is gathered in one task. Within a batch (mtime, file) must differ.
    """
    parsed = parse_changesets(df, package)
    merged = _batches(parsed, batch).where("action = 'merged'")
    head = F.concat(F.lit(RECORD_HEAD.format(package=package)), F.col("bump"), F.lit(RECORD_MIDDLE))
    no_time, no_file = F.lit(None).cast(df.schema["mtime"].dataType), F.lit(None).cast("string")
    ends = merged.select(
        batch,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("piece"), head.alias("text")),
                F.struct(F.lit(2).alias("piece"), F.lit("\n").alias("text")),
            )
        ).alias("_end"),
    ).select(batch, "_end.piece", no_time.alias("mtime"), no_file.alias("file"), "_end.text")
    first = F.col("_first") == F.struct("mtime", "file")
    text = F.when(first, F.col("description")).otherwise(F.concat(F.lit("\n\n"), F.col("description")))
    bodies = (
        parsed.where("description <> ''")
        .join(merged.select(batch, "_first"), batch)
        .select(batch, F.lit(1).alias("piece"), "mtime", "file", text.alias("text"))
    )
    return ends.unionByName(bodies)


def manual_changeset(df: DataFrame, package: str) -> DataFrame:
    """Record text for rows of ``(bump, description)``, as for a release by hand."""
    described = F.coalesce(
        F.nullif("description", F.lit("")), F.concat(F.lit("Manual "), F.col("bump"), F.lit(" release"))
    )
    return df.withColumn(
        "content",
        F.concat(
            F.lit(RECORD_HEAD.format(package=package)), F.col("bump"), F.lit(RECORD_MIDDLE), described, F.lit("\n")
        ),
    )


def added_changesets(diff: DataFrame) -> DataFrame:
    """Change records that a PR adds; other changes to records do not count."""
    path = F.col("path")
    return diff.where(
        (F.col("status") == "A")
        & path.startswith(CHANGESET_PREFIX)
        & path.endswith(CHANGESET_SUFFIX)
        & ~path.endswith(CHANGESET_README)
    ).select("pr_id", F.substring(path, len(CHANGESET_PREFIX) + 1, 1 << 30).alias("file"))


def listed_changesets(files: DataFrame) -> DataFrame:
    """The records among the files of a directory, where there is no diff."""
    name = F.col("file")
    return files.where(name.endswith(CHANGESET_SUFFIX) & (name != CHANGESET_README))


def changeset_gate(prs: DataFrame, diff: DataFrame, changesets: DataFrame, package: str) -> DataFrame:
    """Per PR: ``none``, ``multiple``, or the verdict on its only record."""
    added = added_changesets(diff).groupBy("pr_id").agg(
        F.count("*").alias("n_added"), F.min("file").alias("file")
    )
    content = F.col("content")
    bump = bump_of(content, package, quoted=True)
    judged = changesets.select(
        "file",
        bump.alias("bump"),
        F.when(bump.isNull(), "missing_type")
        .when(F.size(_sections(content)) < 3, "missing_description")
        .when(description_of(content) == "", "empty_description")
        .otherwise("valid")
        .alias("judged"),
    )
    n = F.coalesce("n_added", F.lit(0).cast("bigint"))
    single = F.when(F.col("n_added") == 1, F.col("file"))
    counted = prs.select("pr_id").distinct().join(added.withColumn("file", single), "pr_id", "left")
    return (
        left_join_present(counted, judged, ["file"], F.col("file").isNotNull(), "pr_id")
        .select(
            "pr_id",
            n.alias("n_added"),
            F.when(n == 0, "none")
            .when(n > 1, "multiple")
            .otherwise(F.coalesce("judged", F.lit("unreadable")))
            .alias("verdict"),
            F.when(F.col("judged") == "valid", F.col("bump")).alias("bump"),
        )
    )
