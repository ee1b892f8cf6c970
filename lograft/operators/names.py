"""Archive names for a whole catalogue, and names that several paths share."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lograft.functions.naming import description_for, folder_name, normalized_name, uploaded_name


def assign_archive_names(files: DataFrame) -> DataFrame:
    path = F.col("path")
    uploaded = uploaded_name(path)
    return files.withColumns(
        {
            "normalized": normalized_name(path),
            "uploaded_name": uploaded,
            "gist_name": uploaded,
            "repo_name": folder_name(path),
            "default_description": description_for(path, F.lit(None).cast("string")),
        }
    )


def name_clashes(files: DataFrame) -> DataFrame:
    """Archive names that more than one path maps to.

    The paths are not gathered into a list, since a clash may be of any size:
    ``first_path`` and ``last_path`` are its ends, ``clash_members`` its rows.
    """
    return (
        files.select(folder_name(F.col("path")).alias("repo_name"), "path")
        .distinct()
        .groupBy("repo_name")
        .agg(
            F.count("*").alias("n_paths"),
            F.min("path").alias("first_path"),
            F.max("path").alias("last_path"),
        )
        .where("n_paths > 1")
    )


def clash_members(files: DataFrame) -> DataFrame:
    """One row per path that shares its archive name with another path."""
    named = files.select(folder_name(F.col("path")).alias("repo_name"), "path").distinct()
    clashes = name_clashes(files).select("repo_name", "n_paths")
    return named.join(clashes, "repo_name").select("repo_name", "path", "n_paths")
