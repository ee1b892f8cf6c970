"""Release notes: cleaned, linked to their pull request, and badged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import BADGE_HOST, VERSION_BUMP_TITLE
from lograft.functions.text import WS, first_non_empty, has, js_trim
from lograft.operators.joins import left_join_present

# --- Fixed values: the change section and what is cut from its text ----------
CHANGES = (
    rf"### (Major|Minor|Patch) Changes[{WS}]*\n[{WS}]*-[{WS}]+"
    rf"(?:([a-f0-9]+):[{WS}]+)?([\s\S]+)\z"
)
CLEANING = (
    (r"\\n", "\n"),
    (r"\A(?:\\['\"])+", ""),
    (r"['\"]+\z", ""),
    (r"\A['\"]+", ""),
    ("\\x{1F4E6}[\\s\\S]*\\z", ""),
    (r"---[\s\S]*\z", ""),
)


def with_changes(releases: DataFrame) -> DataFrame:
    """Add change type, commit hash and raw text of the change section; narrow."""

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract("body", CHANGES, group), F.lit(""))

    return releases.withColumns(
        {"change_type": part(1), "found_commit": part(2), "raw_description": part(3)}
    )


def with_pull_requests(releases: DataFrame, commit_pulls: DataFrame) -> DataFrame:
    """Add the change section, and the pull request of the commit, to every release.

    That is the first listed one that is no version bump. The commit named in the
    notes goes before the one passed along, and replaces it. The choice per commit
    is a ``min_by`` combined before the shuffle.
    """
    commits = with_changes(releases).withColumn(
        "commit_sha", first_non_empty(F.col("found_commit"), F.col("commit_sha"))
    )
    chosen = (
        commit_pulls.where(~F.col("title").contains(VERSION_BUMP_TITLE))
        .groupBy("commit_sha")
        .agg(F.min_by("number", "position").alias("pr_number"))
    )
    known = F.col("commit_sha").isNotNull()
    return left_join_present(commits, chosen, ["commit_sha"], known, "release_id")


def link_commits_to_prs(releases: DataFrame, commit_pulls: DataFrame) -> DataFrame:
    """Commit and pull request of each release (``with_pull_requests``), without its text."""
    return with_pull_requests(releases, commit_pulls).select("release_id", "commit_sha", "pr_number")


def cleaned_description(raw: Column) -> Column:
    text = raw
    for pattern, replacement in CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    lines = F.transform(F.split(js_trim(text), "\n", -1), js_trim)
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")


def clean_release_notes(releases: DataFrame, pr_links: DataFrame, package: str) -> DataFrame:
    """``clean_linked`` for links that are a table of their own: one more parse and join."""
    return clean_linked(
        with_changes(releases).join(pr_links.select("release_id", "pr_number"), "release_id", "left"), package
    )


def clean_linked(releases: DataFrame, package: str) -> DataFrame:
    """New bodies; releases that are badged already or have no changes keep theirs.

    ``releases`` come from ``with_pull_requests``, parsed and linked. ``status`` says
    which: ``formatted``, ``already_formatted`` or ``no_changes``.
    """
    version = F.regexp_replace("version", r"\Av", "")
    badge = F.concat(
        F.lit("[![npm version](https://img.shields.io/badge/npm-"),
        version,
        F.lit(f"-blue.svg)](https://www.npmjs.com/package/{package}/v/"),
        version,
        F.lit(")"),
    )
    link = F.when(
        F.col("pr_number") != 0,
        F.concat(F.lit("\n\n**Related Pull Request:** #"), F.col("pr_number").cast("string")),
    )
    done = has(F.col("body"), BADGE_HOST)
    unusable = F.col("raw_description").isNull()
    formatted = F.concat(
        cleaned_description(F.col("raw_description")),
        F.coalesce(link, F.lit("")),
        F.lit("\n\n---\n\n"),
        badge,
    )
    return releases.select(
        "release_id",
        F.when(done, "already_formatted").when(unusable, "no_changes").otherwise("formatted").alias("status"),
        F.when(done | unusable, F.col("body")).otherwise(formatted).alias("body"),
    )
