"""Readable sizes and chunk arithmetic, in integers only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lograft.constants import SIZE_UNITS
from lograft.functions.text import int_div


def ceil_div(a: Column, b: int) -> Column:
    return int_div(a + F.lit(b - 1), b)


def readable_size(size: Column) -> Column:
    """``1152`` -> ``1.13 KB``: two decimals, ties up, no thousands commas.

    Whole and fractional parts are split before scaling, so that nothing
    overflows up to the BIGINT limit.
    """
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        step = 1024**power
        rest = size % step
        hundredths = int_div(size, step) * 100 + int_div(rest * 100 + step // 2, step)
        scaled = F.concat(
            int_div(hundredths, 100).cast("string"),
            F.lit("."),
            F.lpad((hundredths % 100).cast("string"), 2, "0"),
            F.lit(f" {unit}"),
        )
        text = F.when(size >= step, scaled).otherwise(text)
    return text
