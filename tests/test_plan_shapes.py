"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from lograft.plans import bindings as b
from lograft.plans.queries import QUERIES
from lograft.operators import audit, dedup, listings, planning

SF_DIR = "/root/testdata/sf0.001"


def plan_text(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


LAZY = [n for n in QUERIES if n not in ("o12_write_archive", "o27_stream_archive")]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_no_group_in_one_task(spark, name):
    text = plan_text(QUERIES[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "\n+- Window", "- Window ", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroups"):
        assert operator not in text, operator
    assert "listagg" not in text and "collect_list" not in text


def test_planning_reads_sizes_not_bodies(spark, tmp_path):
    path = str(tmp_path / "files")
    b.log_files(spark, SF_DIR).write.parquet(path)
    files = spark.read.parquet(path)
    text = plan_text(planning.plan_uploads(b.requests(spark, SF_DIR), files))
    assert "ReadSchema: struct<path:string,size_bytes:bigint>" in text


def test_filters_reach_the_scan(spark):
    text = plan_text(b.table(spark, SF_DIR, "documents").where("doc_id = 5").select("source"))
    assert "EqualTo(doc_id,5)" in text and "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_first_wins_is_combined_before_the_shuffle(spark):
    contents = listings.explode_listing(b.archive_listings(spark, SF_DIR), "listing", "folder")
    plan = planning.plan_uploads(b.requests(spark, SF_DIR), b.log_files(spark, SF_DIR), **b.LIMITS)
    text = plan_text(dedup.dedup_uploads(plan, contents))
    assert "partial_min(struct(" in text


def test_excluded_files_are_not_opened(spark, tmp_path):
    for folder in ("a", "node_modules"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.js").write_text("1\n")
    (tmp_path / "x.txt").write_text("1\n")
    df = audit.count_lines(spark, str(tmp_path))
    assert [(r.relative_path, r.lines) for r in df.collect()] == [("a/x.js", 2)]


def test_skewed_join_is_split(spark):
    """A path that a third of all requests share becomes several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        asked = b.requests_from(
            spark.range(0, 30000, 1, 16).select(
                F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.col("id").alias("user_id")
            ),
            F.lit(200),
        )
        df = planning.plan_uploads(asked, b.log_files(spark, SF_DIR), **b.LIMITS)
        counted = df.select("request_id", "url", "repository_path")
        counted.collect()
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
