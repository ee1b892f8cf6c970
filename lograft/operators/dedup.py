"""Skip what the archive already has, and what an earlier request brings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lograft.constants import BROKEN_LISTING, CHUNK_GRANULARITY, CHUNK_SIZE, DEFAULT_BRANCH, REPO
from lograft.functions.urls import tree_url
from lograft.operators.chunks import part_count
from lograft.operators.folders import count_folders
from lograft.operators.joins import left_join_present
from lograft.operators.repositories import check_shared_repositories, resolve_name_collisions, uses_shared

KEY = ["owner", "repository_name", "repository_path"]


def dedup_uploads(
    plan: DataFrame,
    archive_contents: DataFrame,
    repositories: DataFrame | None = None,
    chunk_size: int = CHUNK_SIZE,
    granularity: int = CHUNK_GRANULARITY,
) -> DataFrame:
    """Mark shared-archive uploads whose folder exists or was asked for earlier.

    The key is the folder, not the content. The first request per key is found by
    a ``min`` combined before the shuffle, joined to the folder listing while both
    have one row per key, and only then joined back to the requests: a key with a
    third of all requests is a skewed probe side that adaptive execution splits.
    Rows that cannot be duplicates get a spread-out key that matches nothing.

    With ``repositories``, targets that fail their visibility check are marked
    ``error`` and never count as duplicates; so are uploads to a folder whose
    listing cannot be parsed. ``plan`` is read twice; hand in a
    written or checkpointed one where its join is costly.
    """
    shared = uses_shared()
    staged = part_count(F.col("size_bytes"), chunk_size, granularity)
    state = (
        plan.where(shared)
        .groupBy(*KEY)
        .agg(F.min(F.struct("requested_at", "request_id", staged.alias("staged"))).alias("_first"))
        .join(
            count_folders(archive_contents, KEY).select(
                *KEY,
                F.col("file_count").alias("_listed"),
                F.col("raw_url").alias("_listed_url"),
                F.col("branch").alias("_listed_branch"),
                F.col("malformed").alias("_broken"),
            ),
            KEY,
            "left",
        )
    )
    if repositories is None:
        state = state.withColumns(
            {"_action": F.lit(None).cast("string"), "_branch": F.col("_listed_branch"), "_error": F.lit(None).cast("string")}
        )
    else:
        checks = check_shared_repositories(plan, repositories).select(
            "owner",
            "repository_name",
            F.col("action").alias("_action"),
            F.col("branch").alias("_branch"),
            F.col("error").alias("_error"),
        )
        state = state.join(checks, ["owner", "repository_name"], "left")
    joined = left_join_present(plan, state, KEY, shared, "request_id")
    broken = F.col("_first").isNotNull() & F.coalesce("_broken", F.lit(False))
    refused = F.coalesce(F.col("_action") == "error", F.lit(False)) | broken
    active = F.col("_first").isNotNull() & ~refused
    in_archive = active & F.col("_listed").isNotNull()
    repeated = active & ~in_archive & (F.col("_first.request_id") != F.col("request_id"))
    branch = F.coalesce("_branch", "_listed_branch", F.lit(DEFAULT_BRANCH))
    return joined.withColumns(
        {
            "deduplicated": in_archive | repeated,
            "duplicate_of": F.when(in_archive, "archive").when(repeated, "batch"),
            "file_count": F.when(in_archive, F.col("_listed"))
            .when(active, F.col("_first.staged"))
            .otherwise(F.col("file_count"))
            .cast("bigint"),
            "raw_url": F.when(in_archive, F.col("_listed_url")).otherwise(F.col("raw_url")),
            "url": F.when(active, tree_url(*(F.col(c) for c in KEY[:2]), branch, F.col(KEY[2])))
            .when(refused, F.lit(None))
            .otherwise(F.col("url")),
            "action": F.when(refused, "error").otherwise(F.col("_action")),
            "error": F.coalesce("_error", F.when(broken, BROKEN_LISTING)),
        }
    ).drop("_first", "_listed", "_listed_url", "_listed_branch", "_broken", "_action", "_branch", "_error")


def uploads_to_write(deduplicated: DataFrame) -> DataFrame:
    """Rows whose file has to be written: one per folder that is new."""
    return deduplicated.where(
        uses_shared() & ~F.col("deduplicated") & F.coalesce(F.col("action") != "error", F.lit(True))
    )


def dedicated_to_write(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Files that get a repository of their own, under its final name; failed claims are left out.

    ``taken``: (owner, name) of repositories that exist. The rows have the
    columns of a shared upload, without a ``repository_path``.
    """
    names = resolve_name_collisions(plan, taken).where("not failed").select("request_id", "final_name")
    return plan.where(F.col("type") == REPO).join(names, "request_id").select(
        "owner",
        F.col("final_name").alias("repository_name"),
        F.lit(None).cast("string").alias("repository_path"),
        "path",
        "size_bytes",
    )
