"""Which tier a file belongs to, and in how many chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lograft.constants import (
    CHUNK_SIZE,
    GIST,
    REASON_GIST,
    REASON_REPO,
    REASON_SPLIT_HEAD,
    REASON_SPLIT_TAIL,
    REPO,
    SMALL_TIER_LIMIT,
)
from lograft.functions.sizes import ceil_div, readable_size


def tier_columns(size: Column, gist_limit: int, chunk_size: int) -> dict[str, Column]:
    small = size <= gist_limit
    split = ~small & (size > chunk_size)
    chunks = ceil_div(size, chunk_size)
    return {
        "type": F.when(small, GIST).when(size.isNotNull(), REPO),
        "needs_split": split,
        "num_chunks": F.when(~small, chunks),
        "chunk_size": F.when(~small, F.lit(chunk_size).cast("bigint")),
        "reason": F.when(small, REASON_GIST)
        .when(split, F.concat(F.lit(REASON_SPLIT_HEAD), chunks.cast("string"), F.lit(REASON_SPLIT_TAIL)))
        .when(size.isNotNull(), REASON_REPO),
    }


def classify_strategy(
    files: DataFrame, gist_limit: int = SMALL_TIER_LIMIT, chunk_size: int = CHUNK_SIZE
) -> DataFrame:
    """Add tier, split flag, chunk count, reason and readable size to ``files``."""
    size = F.col("size_bytes")
    return files.withColumns(
        {**tier_columns(size, gist_limit, chunk_size), "readable_size": readable_size(size)}
    )
