"""Upload plan: for each valid request, where its file would go and as what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import (
    CHUNK_SIZE,
    DRY_DEDICATED_URL,
    DRY_GIST_URL,
    DRY_SHARED_URL_HEAD,
    GIST,
    REPO,
    SMALL_TIER_LIMIT,
)
from lograft.functions.naming import description_for, folder_name, shared_repository, uploaded_name
from lograft.functions.text import is_true
from lograft.operators.requests import valid_requests
from lograft.operators.strategy import tier_columns


# What a plan keeps of the request, and what it adds.
CARRIED = ("request_id", "owner", "path", "requested_at")
PLAN = (
    "size_bytes",
    "type",
    "needs_split",
    "num_chunks",
    "url",
    "raw_url",
    "file_name",
    "repository_name",
    "repository_path",
    "file_count",
    "is_public",
    "shared_repository",
    "only_gist",
    "dry_mode",
    "deduplicated",
    "upload_description",
)


def target_repository(path: Column, is_public: Column, shared: Column) -> Column:
    return F.when(shared, shared_repository(is_public)).otherwise(folder_name(path))


def plan_uploads(
    requests: DataFrame,
    files: DataFrame,
    gist_limit: int = SMALL_TIER_LIMIT,
    chunk_size: int = CHUNK_SIZE,
) -> DataFrame:
    """One row per valid request. Requests for a self-test upload no file.

    One join on ``path``; everything after it is a narrow projection.
    """
    path = F.col("path")
    valid = valid_requests(requests, files)
    tier = tier_columns(F.col("size_bytes"), gist_limit, chunk_size)
    is_repo = F.col("type") == REPO
    shared = is_repo & F.col("shared_repository")
    carried = [c for c in requests.columns if c in CARRIED]
    return (
        valid.withColumns(
            {
                "type": F.when(is_true(F.col("only_gist")), GIST)
                .when(is_true(F.col("only_repository")), REPO)
                .otherwise(tier["type"]),
                "needs_split": F.col("size_bytes") > chunk_size,
                "num_chunks": tier["num_chunks"],
            }
        )
        .withColumn("_folder", F.when(is_repo, folder_name(path)))
        .withColumns(
            {
                "file_name": F.when(~is_repo, uploaded_name(path)),
                "repository_name": F.when(shared, shared_repository(F.col("is_public"))).otherwise(F.col("_folder")),
                "repository_path": F.when(shared, F.col("_folder")),
                "upload_description": description_for(path, F.col("description")),
            }
        )
        .withColumns(
            {
                "url": F.when(~is_repo, DRY_GIST_URL)
                .when(
                    shared,
                    F.concat(
                        F.lit(DRY_SHARED_URL_HEAD),
                        F.col("repository_name"),
                        F.lit("/"),
                        F.col("repository_path"),
                    ),
                )
                .otherwise(DRY_DEDICATED_URL),
                "raw_url": F.lit(None).cast("string"),
                "file_count": F.lit(1).cast("bigint"),
                "deduplicated": F.lit(False),
            }
        )
        .select(*carried, *PLAN)
    )
