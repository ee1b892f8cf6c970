"""Summaries of plans and of self-test outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lograft.functions.sizes import readable_size


def strategy_summary(plan: DataFrame) -> DataFrame:
    """Counts and bytes per tier and visibility, with sub-totals and a total.

    ``level`` is 0 for a (type, is_public) row, 1 per type, 3 for the total.
    """
    return (
        plan.rollup("type", "is_public")
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.count("*").alias("n_files"),
            F.sum("size_bytes").alias("total_bytes"),
            F.count_if("needs_split").alias("n_split"),
            F.coalesce(F.sum("num_chunks"), F.lit(0)).alias("n_chunks"),
        )
        .withColumn("readable_total", readable_size(F.col("total_bytes")))
    )


def outcome_summary(outcomes: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """Passed, failed and total per suite; a suite without outcomes has passed.

    ``suites`` names the suites to report; without it, those that have outcomes.
    """
    ok = F.coalesce("passed", F.lit(False))
    counts = outcomes.groupBy("suite").agg(
        F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count("*").alias("total")
    )
    if suites is not None:
        counts = suites.select("suite").distinct().join(counts, "suite", "left").na.fill(0)
    return counts.withColumn("all_passed", F.col("failed") == 0)
