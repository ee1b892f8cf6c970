"""Filters judged while listing, and files as a stream."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lograft.operators import catalogue
from lograft.plans import queries
from lograft.sources import archive, textfiles
from lograft.sources.bytechunks import ByteChunks
from lograft.sources import catalogue as source
from lograft.streaming.archive_stream import stream_files

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@pytest.fixture
def pushing(spark):
    spark.conf.set(PUSHDOWN, "true")
    yield spark
    spark.conf.unset(PUSHDOWN)


@pytest.fixture
def tree(tmp_path):
    for folder in ("a", "a/b", "ab", "c/d/e", "c/f"):
        (tmp_path / folder).mkdir(parents=True)
        for name, size in (("x.log", 3), ("y.txt", 30)):
            (tmp_path / folder / name).write_bytes(b"z" * size)
    return str(tmp_path)


def test_filters_reach_the_listing(pushing, tree, rows):
    def files():
        return pushing.read.format("file_catalogue").option("pushdown", "true").load(tree)

    catalogue.scan_log_files(pushing, tree)
    wanted = files().where(F.col("relative_path").startswith("a/") & (F.col("size_bytes") > 5) & F.col("name").endswith(".txt"))
    assert rows(wanted, "relative_path") == [("a/b/y.txt",), ("a/y.txt",)]
    assert ") Filter" not in wanted._jdf.queryExecution().executedPlan().toString()
    exact = files().where((F.col("path") == f"{tree}/c/f/x.log") | (F.col("size_bytes") == 30)).count()
    assert exact == 6 and files().where("name in ('x.log', 'z') and size_bytes between 1 and 3").count() == 5
    pushing.dataSource.register(ByteChunks)
    chunks = pushing.read.format("bytechunks").option("pushdown", "true").option("chunkBytes", 10)
    assert chunks.load(tree).where(F.col("path").startswith(f"{tree}/c/") & (F.col("length") == 10)).count() == 6


def test_limits_of_a_scan(spark, tree, rows):
    df = catalogue.scan_log_files(spark, tree, prefix="a", min_bytes=4)
    assert rows(df, "relative_path") == [("a/b/y.txt",), ("a/y.txt",), ("ab/y.txt",)]
    assert catalogue.scan_log_files(spark, tree, max_bytes=3).count() == 5


@pytest.mark.parametrize("fan_out", [1, 100])
def test_directories_that_cannot_match_are_not_opened(tree, monkeypatch, fan_out):
    from pyspark.sql.datasource import EqualTo, IsNotNull, Not, StringStartsWith

    reader = source.PushingReader(tree, (), fan_out)
    left = list(
        reader.pushFilters(
            [StringStartsWith(("relative_path",), "c/d"), IsNotNull(("path",)), Not(EqualTo(("name",), "q")), EqualTo(("modified_at",), 1)]
        )
    )
    assert len(left) == 2
    opened = []
    real = source.pafs.FileSelector
    monkeypatch.setattr(source.pafs, "FileSelector", lambda d, **k: opened.append(os.path.relpath(d, tree)) or real(d, **k))
    found = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("relative_path").to_pylist()]
    assert sorted(found) == ["c/d/e/x.log", "c/d/e/y.txt"]
    assert set(opened) == {".", "c", "c/d", "c/d/e"}


def test_suffixes_are_judged_while_listing(spark, tree):
    df = catalogue.scan_log_files(spark, tree, (".log",), ("ab",))
    assert df.count() == 4 and ") Filter" not in df._jdf.queryExecution().executedPlan().toString()


def put(folder, name, size, age=0.0):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(os.urandom(size))
    moment = time.time() - age
    os.utime(path, (moment, moment))


def test_late_files_are_not_lost(tmp_path):
    put(tmp_path, "old.log", 1, age=7200)
    stream = source.CatalogueStream(str(tmp_path))
    stream.lateness, stream.full_every = 60_000_000, 3

    def batch(offset):
        return sorted(r[1] for p in stream.partitions({}, offset) for r in stream.read(p))

    first = stream.latestOffset()
    assert batch(first) == ["old.log"]
    put(tmp_path, "new.log", 1)
    put(tmp_path, "late.log", 1, age=30)
    put(tmp_path, "very-late.log", 1, age=7200)
    second = stream.latestOffset()
    assert batch(second) == ["late.log", "new.log"]
    # A replay has the same bounds; the next full batch brings what came too late for its own.
    assert batch(first) == ["late.log", "old.log", "very-late.log"] and batch(second) == ["late.log", "new.log"]
    stream.latestOffset()
    assert batch(stream.latestOffset()) == ["late.log", "new.log", "old.log", "very-late.log"]


def test_stream_tasks_share_directories(tmp_path):
    for i in range(30):
        put(tmp_path / f"part={i}", "x.log", 1, age=7200 if i % 2 else 0)
    stream = source.CatalogueStream(str(tmp_path), fan_out=4)
    now = time.time_ns() // 1000
    parts = stream.partitions({}, {"after": now - 3_600_000_000, "until": now})
    assert len(parts) == 4
    assert sorted(r[1] for p in parts for r in stream.read(p)) == sorted(f"part={i}/x.log" for i in range(0, 30, 2))


def test_files_are_archived_once(spark, tmp_path):
    inbox, root, checkpoint = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "checkpoint")
    put(inbox, "small.log", 5)
    put(inbox, "a/two.log", 45)
    put(inbox, "skip.bin", 45)
    limits = {"gist_limit": 10, "chunk_size": 20, "granularity": 1}

    def run():
        stream_files(spark, str(inbox), root, checkpoint, "me", suffixes=(".log",), **limits).awaitTermination()
        return sorted((r.repository_path.split("-")[-1], r.size_bytes) for r in archive.read_listing(spark, root).collect())

    two = [("two", 5), ("two", 20), ("two", 20)]
    assert run() == two
    put(inbox, "a/late.log", 15, age=1e6)
    assert run() == sorted([*two, ("late", 15)])
    assert run() == sorted([*two, ("late", 15)])
    bodies = archive.read_archive(spark, root).where("repository_path like '%two'").orderBy("chunk_name").collect()
    assert b"".join(bytes(r.content) for r in bodies) == (inbox / "a/two.log").read_bytes()


def test_text_files_need_nothing_but_themselves(spark, tmp_path):
    """What the stream finds: a file for a hundred documents, without the checksum files and their processes that Hadoop adds."""
    root = str(tmp_path / "inbox")
    docs = [(5, "b"), (None, "lost"), (130, ""), (4, "aé"), (131, None), (-101, "minus"), (5, "b")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    queries._write_text_files(frame, root)
    queries._write_text_files(frame.where("doc_id > 100"), root)
    found = sorted((p.parent.name, p.read_bytes().decode()) for p in (tmp_path / "inbox").rglob("*") if p.is_file())
    two = [("part=1", "\n\n")] * 2
    assert found == [("part=-1", "minus\n"), ("part=0", "aé\nb\nb\n"), *two, (f"part={textfiles.NO_KEY}", "lost\n")]
    assert {p.name for p in (tmp_path / "inbox").iterdir()} == {name for name, _ in found}
    frame.select(F.expr("doc_id div 100").alias("part"), "text").write.partitionBy("part").text(str(tmp_path / "spark"))
    assert {p.name for p in (tmp_path / "spark").glob("part=*")} == {name for name, _ in found}
    queries._write_text_files(frame.where("false"), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_text_files_of_a_repeated_attempt(tmp_path):
    root = str(tmp_path)
    os.mkdir(textfiles.staging(root, "c"))
    dead, second, twin = (textfiles.TextFiles(root, "part", "c") for _ in range(3))
    for files in (dead, second, twin):
        files.append(1, b"x\n")
        files.append(2, b"y\n")
    # The first file is whole once the next has begun; what was open when its task died is not there.
    assert [p.parent.name for p in tmp_path.glob("part=*/*")] == ["part=1"]
    second.append(2, b"z\n")
    second.close()
    twin.append(2, b"z\n")
    twin.close()
    assert sorted((p.parent.name, p.read_bytes()) for p in tmp_path.glob("part=*/*")) == [("part=1", b"x\n"), ("part=2", b"y\nz\n")]
