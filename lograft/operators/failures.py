"""Failure labels over attempt logs, and what each request came to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import (
    CHUNK_GRANULARITY,
    CHUNK_SIZE,
    DEFAULT_BRANCH,
    GIST,
    GIST_FAILURE_HEAD,
    GIST_OPERATION,
    HINT_HEAD,
    HINT_TAIL,
    MISSING_REF_PHRASES,
    NAME_CONFLICT_PHRASE,
    NO_SPACE_CODE,
    NO_SPACE_HEAD,
    NO_SPACE_PHRASE,
    NO_SPACE_TAIL,
    NOT_FOUND_PHRASES,
    REPO,
    REPO_FALLBACK_OPERATION,
    REPO_OPERATION,
    SMALL_TIER_LIMIT,
    STATUS_CREATED,
    STATUS_DRY,
    STATUS_DUPLICATE,
    UNKNOWN_ERROR,
)
from lograft.functions.naming import folder_name, uploaded_name
from lograft.functions.sizes import readable_size
from lograft.functions.text import first_non_empty, has, has_any_case, is_true, js_trim
from lograft.functions.urls import found_gist_url, found_repository_url, repository_url, tree_url
from lograft.operators.chunks import part_count
from lograft.operators.planning import target_repository

LABELS = ("no_space", "name_conflict", "not_found", "missing_ref")


def classify_failures(attempts: DataFrame) -> DataFrame:
    """Add independent labels, the exit code and the error detail; narrow.

    Labels are never NULL. ``child_exit_code`` is used where ``exit_code`` is
    NULL, if the column is there.
    """
    message, stdout, stderr = F.col("message"), F.col("stdout"), F.col("stderr")
    child = [F.col("child_exit_code")] if "child_exit_code" in attempts.columns else []
    code = F.coalesce(F.col("exit_code"), *child, F.lit(0)).cast("bigint")
    output = first_non_empty(stderr, stdout)
    return attempts.withColumns(
        {
            "no_space": F.coalesce(F.col("error_code") == NO_SPACE_CODE, F.lit(False))
            | has(message, NO_SPACE_CODE)
            | has_any_case(message, NO_SPACE_PHRASE)
            | has(stderr, NO_SPACE_CODE)
            | has_any_case(stderr, NO_SPACE_PHRASE),
            "name_conflict": has_any_case(stderr, NAME_CONFLICT_PHRASE),
            "not_found": has_any_case(output, *NOT_FOUND_PHRASES),
            "missing_ref": has_any_case(output, *MISSING_REF_PHRASES),
            "exit": code,
            "detail": F.when(
                code != 0,
                first_non_empty(
                    js_trim(stderr),
                    js_trim(stdout),
                    F.concat(F.lit("Command exited with code "), code.cast("string")),
                ),
            ),
        }
    )


def failure_counts(attempts: DataFrame) -> DataFrame:
    """Attempts, failures and label counts per stage."""
    return (
        classify_failures(attempts)
        .groupBy("stage")
        .agg(
            F.count("*").alias("n_attempts"),
            F.count_if((F.col("exit") != 0) | F.col("error_code").isNotNull()).alias("n_failed"),
            *(F.count_if(F.col(label)).alias(f"n_{label}") for label in LABELS),
        )
    )


def extract_urls(outputs: DataFrame) -> DataFrame:
    """Add the repository URL and the gist URL and id found in ``stdout``; narrow."""
    gist = found_gist_url(F.col("stdout"))
    return outputs.withColumns(
        {
            "repository_url": found_repository_url(F.col("stdout")),
            "gist_url": gist,
            "gist_id": F.substring_index(gist, "/", -1),
        }
    )


def url_targets(outputs: DataFrame) -> DataFrame:
    """How often each extracted URL occurs; counted before the shuffle."""
    found = extract_urls(outputs).select(
        F.explode(
            F.array(
                F.struct(F.lit(REPO).alias("kind"), F.col("repository_url").alias("url")),
                F.struct(F.lit(GIST).alias("kind"), F.col("gist_url").alias("url")),
            )
        ).alias("t")
    )
    return found.where("t.url is not null").groupBy("t.kind", "t.url").agg(F.count("*").alias("uses"))


def no_space_error(operation: str) -> Column:
    return F.lit(NO_SPACE_HEAD + operation + NO_SPACE_TAIL)


def resolve_outcomes(
    plan: DataFrame,
    attempts: DataFrame,
    gist_limit: int = SMALL_TIER_LIMIT,
    chunk_size: int = CHUNK_SIZE,
    granularity: int = CHUNK_GRANULARITY,
) -> DataFrame:
    """What each planned request came to, fallback included, as the full result record.

    ``plan`` is what ``dedup_uploads`` returns: its URLs stand for duplicates, dry runs and
    shared uploads, with the branch it has checked, and what it refused is an error. A column
    ``final_name`` names dedicated repositories whose bare name was taken.

    The last attempt of each stage counts. Attempts are cut down to what the
    decision needs and combined per request before the shuffle, so both sides of
    the join have one row per request.
    """
    failed = F.col("exit") != 0
    raised = F.col("error_code").isNotNull() | first_non_empty(F.col("message")).isNotNull()
    gist_error = first_non_empty(
        F.col("message"),
        F.concat(
            F.lit(GIST_FAILURE_HEAD),
            F.coalesce(js_trim(first_non_empty(F.col("stderr"))), F.lit(UNKNOWN_ERROR)),
        ),
    )
    repo_error = first_non_empty(F.col("message"), F.col("detail"), F.col("error_code"))
    tried = extract_urls(classify_failures(attempts))
    last = {
        GIST: F.struct(
            F.col("gist_url").isNotNull().alias("ok"),
            "no_space",
            gist_error.alias("error"),
            F.col("gist_url").alias("url"),
        ),
        REPO: F.struct(
            (~failed & ~raised).alias("ok"),
            "no_space",
            repo_error.alias("error"),
            F.col("repository_url").alias("url"),
        ),
    }
    stages = tried.groupBy("request_id").agg(
        *(
            F.max_by(value, F.when(F.col("stage") == stage, F.col("attempt_id"))).alias(f"_{stage}")
            for stage, value in last.items()
        )
    )

    gist, repo = F.col("_gist"), F.col("_repo")
    dry, duplicate = F.col("dry_mode"), F.col("deduplicated")
    live = ~dry & ~duplicate
    planned_gist = live & (F.col("type") == GIST)
    planned_repo = live & (F.col("type") == REPO)
    fallback = (
        planned_gist & gist.isNotNull() & ~gist["ok"] & ~gist["no_space"] & ~is_true(F.col("only_gist"))
    )
    gist_done = planned_gist & is_true(gist["ok"])
    gist_full = planned_gist & is_true(~gist["ok"] & gist["no_space"])
    repo_done = (planned_repo | fallback) & is_true(repo["ok"])
    repo_failed = repo.isNotNull() & ~repo["ok"]
    repo_full = repo_failed & repo["no_space"]

    operation = (
        F.when(gist_full, GIST_OPERATION)
        .when(is_true(fallback) & repo_full, REPO_FALLBACK_OPERATION)
        .when(planned_repo & repo_full, REPO_OPERATION)
    )
    hint = F.concat(F.lit(HINT_HEAD), readable_size(F.col("size_bytes")), F.lit(HINT_TAIL))
    error = (
        F.when(gist_full, no_space_error(GIST_OPERATION))
        .when(planned_gist & gist.isNotNull() & ~gist["ok"] & is_true(F.col("only_gist")), gist["error"])
        .when(is_true(fallback) & repo_full, no_space_error(REPO_FALLBACK_OPERATION))
        .when(is_true(fallback) & repo_failed, repo["error"])
        .when(
            planned_repo & repo_full & (F.col("size_bytes") <= gist_limit),
            F.concat(no_space_error(REPO_OPERATION), hint),
        )
        .when(planned_repo & repo_full, no_space_error(REPO_OPERATION))
        .when(planned_repo & repo_failed, repo["error"])
    )
    owner, path, shared = F.col("owner"), F.col("path"), F.col("shared_repository")
    name = target_repository(path, F.col("is_public"), shared)
    if "final_name" in plan.columns:
        name = F.when(shared, name).otherwise(F.coalesce("final_name", name))
    refused = F.col("action") == "error" if "action" in plan.columns else F.lit(False)
    refused = planned_repo & is_true(refused)
    shared_url = F.when(F.col("type") == REPO, F.col("url")).otherwise(
        tree_url(owner, name, F.lit(DEFAULT_BRANCH), folder_name(path))
    )
    repo_url = F.when(shared, shared_url).otherwise(F.coalesce(repo["url"], repository_url(owner, name)))
    as_planned = dry | duplicate
    by_gist = is_true(gist_done)
    by_repo = is_true(repo_done) & ~refused
    kind = F.when(as_planned, F.col("type")).when(by_gist, GIST).when(by_repo, REPO)
    if "error" in plan.columns:
        error = F.when(refused, F.col("error")).otherwise(error)
    return plan.join(stages, "request_id", "left").select(
        "request_id",
        kind.alias("type"),
        F.when(dry, STATUS_DRY)
        .when(duplicate, STATUS_DUPLICATE)
        .when(by_gist | by_repo, STATUS_CREATED)
        .when(error.isNotNull(), "error")
        .otherwise("pending")
        .alias("status"),
        (is_true(fallback) & by_repo).alias("fell_back"),
        F.when(as_planned, F.col("url")).when(by_gist, gist["url"]).when(by_repo, repo_url).alias("url"),
        F.when(duplicate & ~dry, F.col("raw_url")).alias("raw_url"),
        F.when(kind == GIST, uploaded_name(path)).alias("file_name"),
        F.when(as_planned, F.col("file_count"))
        .when(by_gist, F.lit(1))
        .when(by_repo, part_count(F.col("size_bytes"), chunk_size, granularity))
        .cast("bigint")
        .alias("file_count"),
        "is_public",
        F.when(as_planned, F.col("repository_name")).when(by_repo, name).alias("repository_name"),
        F.when(as_planned, F.col("repository_path"))
        .when(by_repo & shared, folder_name(path))
        .alias("repository_path"),
        "deduplicated",
        F.when(~refused, operation).alias("error_operation"),
        error.alias("error"),
    )
