import os

import pytest
from pyspark.sql import functions as F

from lograft.operators import catalogue
from lograft.operators.planning import plan_uploads
from lograft.sources import archive
from lograft.streaming.archive_stream import archive_batch, asked_buckets, dedup_within_watermark, stream_archive, stream_requests

SCHEMA = "request_id bigint, owner string, path string, requested_at timestamp, public boolean"
LIMITS = {"gist_limit": 10, "chunk_size": 20, "granularity": 1}


@pytest.fixture
def files(spark):
    bodies = {"/small.log": b"x" * 10, "/one.log": b"y" * 20, "/two.log": b"z" * 45, "/late.log": b"w" * 21}
    return spark.createDataFrame(
        [(p, len(b), bytearray(b)) for p, b in bodies.items()], "path string, size_bytes bigint, content binary"
    )


def put(spark, folder, *paths, public=None, first_id=0):
    rows = [(first_id + i, "me", p, None, public) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("requested_at", F.timestamp_seconds(F.col("request_id")))
    df.coalesce(1).write.mode("append").parquet(folder)


def listed(spark, root):
    return sorted((r.repository, r.repository_path, r.chunk_name, r.size_bytes) for r in archive.read_listing(spark, root).collect())


TWO = [("private-logs", "log-two", f"two.part-0{i}.log.txt", n) for i, n in enumerate((20, 20, 5))]
ONE = [("private-logs", "log-one", "one.log.txt", 20)]


def test_stream_adds_each_folder_once(spark, files, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "archive")
    put(spark, inbox, "/small.log", "/one.log", "/two.log", "/two.log", "/nowhere.log")

    def run(checkpoint):
        stream_archive(
            stream_requests(spark, inbox, SCHEMA), files, root, str(tmp_path / checkpoint), **LIMITS
        ).awaitTermination()

    run("first")
    assert listed(spark, root) == sorted(ONE + TWO)
    run("first")
    assert listed(spark, root) == sorted(ONE + TWO)
    run("second")  # a new stream over the same requests
    assert listed(spark, root) == sorted(ONE + TWO)
    put(spark, inbox, "/two.log", "/late.log", first_id=10)
    put(spark, inbox, "/one.log", public=True, first_id=20)
    run("first")
    late = [("private-logs", "log-late", f"late.part-0{i}.log.txt", n) for i, n in enumerate((20, 1))]
    public = [("public-logs", "log-one", "one.log.txt", 20)]
    assert listed(spark, root) == sorted(ONE + TWO + late + public)
    assert archive.read_archive(spark, root).count() == len(ONE + TWO + late + public)


def test_replayed_batch_writes_the_same(spark, files, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "archive")
    put(spark, inbox, "/one.log", "/two.log")
    batch = spark.read.schema(SCHEMA).parquet(inbox)
    for _ in range(2):
        archive_batch(batch, files, root, "w", 3, **LIMITS)
        assert listed(spark, root) == sorted(ONE + TWO)
    archive_batch(batch, files, root, "w", 4, **LIMITS)
    assert listed(spark, root) == sorted(ONE + TWO)


def test_a_batch_opens_its_own_part_of_the_listing(spark, files, tmp_path):
    inbox, root = str(tmp_path / "in"), str(tmp_path / "archive")
    names = [f"/file{i:03d}.log" for i in range(60)]
    many = spark.createDataFrame([(p, 20, bytearray(b"v" * 20)) for p in names], files.schema)
    put(spark, inbox, *names)
    batch = spark.read.schema(SCHEMA).parquet(inbox)
    archive_batch(batch, many, root, "w", 0, **LIMITS)
    again = batch.where(F.col("path") == names[7])
    buckets = asked_buckets(plan_uploads(again, many, LIMITS["gist_limit"], LIMITS["chunk_size"]))
    found = archive.read_listing(spark, root, buckets)
    assert len(buckets) == 1 and "log-file007" in {r.repository_path for r in found.collect()}
    assert {f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()} == {str(buckets[0])}
    whole = archive.read_listing(spark, root)
    assert whole.count() == 60 and len({f.split("bucket=")[1].split("/")[0] for f in whole.inputFiles()}) > 20


def test_bodies_from_storage(spark, tmp_path):
    store, inbox, root = tmp_path / "store", str(tmp_path / "in"), str(tmp_path / "archive")
    store.mkdir()
    body = os.urandom(45)
    (store / "two.log").write_bytes(body)
    found = catalogue.scan_log_files(spark, str(store)).select("path", "size_bytes")
    put(spark, inbox, f"{store}/two.log")
    archive_batch(spark.read.schema(SCHEMA).parquet(inbox), found, root, "w", 0, **LIMITS)
    rows = archive.read_archive(spark, root).orderBy("chunk_name").collect()
    assert b"".join(bytes(r.content) for r in rows) == body and len(rows) == 3


def test_dedup_without_an_archive(spark, tmp_path):
    inbox = str(tmp_path / "in")
    put(spark, inbox, "/a.log", "/a.log", "/b.log")
    stream = stream_requests(spark, inbox, SCHEMA).withColumns(
        {"repository_name": F.lit("private-logs"), "repository_path": F.col("path")}
    )
    query = (
        dedup_within_watermark(stream)
        .writeStream.format("memory")
        .queryName("kept")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.path for r in spark.table("kept").collect()) == ["/a.log", "/b.log"]


def test_dedup_keeps_what_has_no_folder(spark, tmp_path):
    inbox = str(tmp_path / "in")
    put(spark, inbox, "/a.log", "/b.log", "/c.log", "/c.log", first_id=10)  # a time of 0 would be late
    folder = F.when(F.col("path") == "/c.log", "log-c")
    stream = stream_requests(spark, inbox, SCHEMA).withColumns(
        {"repository_name": F.lit("private-logs"), "repository_path": folder, "dry_mode": F.col("request_id") == 12}
    )
    query = (
        dedup_within_watermark(stream)
        .writeStream.format("memory")
        .queryName("all_kept")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert sorted(r.request_id for r in spark.table("all_kept").collect()) == [10, 11, 12, 13]
