"""Roll-up of archive listings to one row per folder or gist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import TOKEN_MARK
from lograft.functions.text import has
from lograft.functions.urls import tree_url

FOLDER = ("owner", "repository_name", "branch", "repository_path", "visibility")


def _counted(include_dotfiles: bool) -> Column:
    named = F.col("name").isNotNull()
    return named if include_dotfiles else named & ~F.col("name").startswith(".")


def count_folders(
    archive_contents: DataFrame, keys: Sequence[str], include_dotfiles: bool = True
) -> DataFrame:
    """File count and single-file URL per key, for folders that are present.

    A listing that cannot be parsed is ``malformed`` and has no count.

    Count and max are combined before the shuffle, so a folder of any size sends
    one row per input partition.
    """
    counted = _counted(include_dotfiles)
    broken = F.col("malformed") if "malformed" in archive_contents.columns else F.lit(False)
    others = [c for c in ("branch", "visibility") if c not in keys]
    rolled = (
        archive_contents.where("present")
        .groupBy(*keys)
        .agg(
            F.count_if(counted).alias("file_count"),
            F.max(F.when(counted, F.col("download_url"))).alias("_url"),
            F.max(F.coalesce(broken, F.lit(False))).alias("malformed"),
            *(F.max(c).alias(c) for c in others),
        )
        .withColumn("file_count", F.when(~F.col("malformed"), F.col("file_count")))
    )
    single = F.when(F.col("file_count") == 1, F.nullif(F.col("_url"), F.lit("")))
    return rolled.withColumn("raw_url", single).drop("_url")


def folder_rollup(archive_contents: DataFrame, include_dotfiles: bool = True) -> DataFrame:
    """One row per archive folder: file count, raw URL, tree URL, token flag.

    ``include_dotfiles=False`` counts as a local directory listing does.
    """
    url = tree_url(*(F.col(c) for c in ("owner", "repository_name", "branch", "repository_path")))
    return count_folders(archive_contents, FOLDER, include_dotfiles).withColumns(
        {
            "url": url,
            "token_expires": (F.col("visibility") != "public") & has(F.col("raw_url"), TOKEN_MARK),
        }
    )


def gist_rollup(gist_files: DataFrame, key: str = "gist_id") -> DataFrame:
    """One row per gist. A lookup that failed counts as one file without raw URL."""
    known = F.col("present") & ~F.col("malformed")
    rolled = gist_files.groupBy(key).agg(
        F.max(known).alias("_known"),
        F.count("filename").alias("_files"),
        F.max("raw_url").alias("_url"),
    )
    count = F.when(F.col("_known"), F.col("_files")).otherwise(F.lit(1).cast("bigint"))
    return rolled.select(
        key,
        count.alias("file_count"),
        F.when(F.col("_known") & (F.col("_files") == 1), F.col("_url")).alias("raw_url"),
    )
