"""Joins for left sides of which many rows have no key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_SPREAD = "_spread"
_SLOTS = 65536


def left_join_present(
    left: DataFrame, right: DataFrame, keys: Sequence[str], present: Column, row_id: str
) -> DataFrame:
    """Left join of the rows that are ``present``; the others match nothing.

    Rows without a key would all be hashed to one partition. They get a made-up
    second key from their id instead, which spreads them over all partitions.
    """
    slot = F.when(present, F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64(row_id), F.lit(_SLOTS)))
    return (
        left.withColumn(_SPREAD, slot.cast("bigint"))
        .join(right.withColumn(_SPREAD, F.lit(0).cast("bigint")), [*keys, _SPREAD], "left")
        .drop(_SPREAD)
    )
