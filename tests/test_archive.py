import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lograft.constants import CHUNK_SIZE
from lograft.operators import dedup, folders, listings, repositories
from lograft.sources import archive

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
PLAN = (
    "request_id bigint, owner string, path string, requested_at timestamp, size_bytes bigint, type string, "
    "needs_split boolean, num_chunks bigint, url string, raw_url string, repository_name string, "
    "repository_path string, file_count bigint, is_public boolean, shared_repository boolean, dry_mode boolean"
)
CONTENTS = (
    "owner string, repository_name string, branch string, repository_path string, visibility string, "
    "present boolean, name string, download_url string"
)


def upload(i, path="log-a", at=0, owner="me", public=False, kind="repo", shared=True, dry=False, chunks=None):
    repository = "public-logs" if public else "private-logs"
    return (
        i, owner, f"/{path.removeprefix('log-')}.log", T0 + dt.timedelta(milliseconds=at), (chunks or 0) * CHUNK_SIZE or 10, kind, bool(chunks), chunks, "planned", None,
        repository if kind == "repo" and shared else None, path if kind == "repo" and shared else None, 1, public, shared, dry,
    )


@pytest.fixture
def plan(spark):
    return lambda *uploads: spark.createDataFrame(list(uploads), PLAN)


@pytest.fixture
def contents(spark):
    return lambda *entries: spark.createDataFrame(list(entries), CONTENTS)


def entry(path, name, url=None, present=True, repository="private-logs", branch="main"):
    return ("me", repository, branch, path, "public" if repository == "public-logs" else "private", present, name, url)


def test_archive_hit_returns_the_listing(plan, contents):
    have = contents(entry("log-a", "a.log.txt", "https://raw/a"), entry("log-b", None), entry("log-c", None, present=False))
    df = dedup.dedup_uploads(plan(upload(0), upload(1, "log-b"), upload(2, "log-c")), have)
    got = {r.request_id: (r.deduplicated, r.duplicate_of, r.file_count, r.raw_url) for r in df.collect()}
    assert got == {0: (True, "archive", 1, "https://raw/a"), 1: (True, "archive", 0, None), 2: (False, None, 1, None)}


def test_first_request_of_a_batch_wins(plan, contents):
    df = dedup.dedup_uploads(
        plan(upload(5, at=9), upload(3, at=7, chunks=4), upload(4, at=7), upload(6, at=1, public=True), upload(7, at=0, dry=True)),
        contents(),
    )
    got = {r.request_id: (r.deduplicated, r.duplicate_of, r.file_count) for r in df.collect()}
    assert got == {
        3: (False, None, 4),
        4: (True, "batch", 4),
        5: (True, "batch", 4),
        6: (False, None, 1),
        7: (False, None, 1),
    }


def test_only_shared_archive_uploads_are_deduplicated(plan, contents):
    uploads = [upload(0, kind="gist"), upload(1, kind="gist"), upload(2, shared=False), upload(3, shared=False)]
    df = dedup.dedup_uploads(plan(*uploads), contents(entry("log-a", "a.log.txt")))
    assert df.where("deduplicated").count() == 0 and df.count() == 4
    assert dedup.uploads_to_write(df).count() == 0


def test_hot_key_and_many_rows(spark, plan, contents):
    base = plan(upload(0))
    many = spark.range(5000).select(
        F.col("id").alias("request_id"),
        *(F.lit(base.first()[c]).cast(base.schema[c].dataType).alias(c) for c in base.columns if c not in ("request_id", "repository_path")),
        F.when(F.col("id") % 3 == 0, F.lit("log-hot")).otherwise(F.concat(F.lit("log-"), F.col("id") % 700)).alias("repository_path"),
    )
    df = dedup.dedup_uploads(many, contents())
    assert df.count() == 5000
    fresh = dedup.uploads_to_write(df)
    assert fresh.count() == fresh.select("repository_path").distinct().count() == 701


def test_refused_targets_are_neither_duplicates_nor_written(spark, plan, contents):
    repos = spark.createDataFrame([("me", "private-logs", "main", "public")], "owner string, name string, default_branch string, visibility string")
    df = dedup.dedup_uploads(plan(upload(0), upload(1, at=1), upload(2, public=True)), contents(entry("log-a", "x")), repos)
    got = {r.request_id: (r.deduplicated, r.action) for r in df.collect()}
    assert got == {0: (False, "error"), 1: (False, "error"), 2: (False, "create")}
    assert [r.request_id for r in dedup.uploads_to_write(df).collect()] == [2]


@pytest.mark.parametrize(
    "visibility, branch, expected",
    [
        (None, None, ("create", "main", None)),
        ("private", "dev", ("reuse", "dev", None)),
        ("private", "", ("reuse", "main", None)),
        ("private", None, ("reuse", "main", None)),
        ("public", "dev", ("error", None, "Shared repository private-logs exists with visibility public, expected private")),
    ],
)
def test_shared_repository_check(spark, plan, visibility, branch, expected):
    repos = spark.createDataFrame(
        [("me", "private-logs", branch, visibility)] if visibility else [],
        "owner string, name string, default_branch string, visibility string",
    )
    df = repositories.check_shared_repositories(plan(upload(0), upload(1)), repos)
    assert [(r.action, r.branch, r.error) for r in df.collect()] == [expected]


def simulate(asked, taken):
    """Name claims one after the other."""
    taken, out = set(taken), {}
    for i, at, name in sorted(asked, key=lambda a: (a[1], a[0])):
        ms = int(T0.timestamp() * 1000) + at
        final = name if name not in taken else f"{name}-{ms}"
        failed = final != name and final in taken
        taken.add(final)
        out[i] = (name, final, final != name, failed)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_name_collisions_like_one_after_the_other(spark, plan, seed):
    rng = random.Random(seed)
    start = int(T0.timestamp() * 1000)
    names = ["log-a", "log-b", "log-c-7"]
    for _ in range(3):  # names that look like retries, and retries of those
        names += [f"{n}-{start + rng.randrange(6)}" for n in rng.sample(names, 3)]
    asked = [(i, rng.randrange(6), rng.choice(names)) for i in range(60)]
    taken = rng.sample(names, 2) + [f"{n}-{start + rng.randrange(6)}" for n in rng.sample(names, 2)]
    repos = spark.createDataFrame([("me", n) for n in taken], "owner string, name string")
    df = repositories.resolve_name_collisions(plan(*(upload(i, n, at, shared=False) for i, at, n in asked)), repos)
    got = {r.request_id: (r.base_name, r.final_name, r.collided, r.failed) for r in df.collect()}
    assert got == simulate(asked, taken)


def test_folder_rollup(contents):
    df = contents(
        entry("log-a", "a.log.txt", "https://raw/a?token=1"),
        entry("log-b", "b1", "u"), entry("log-b", "b2", "v"),
        entry("log-c", ".c.log.txt", ""),
        entry("log-d", None),
        entry("log-e", "e", "https://raw/e?token=1", repository="public-logs", branch="dev"),
        entry("log-f", None, present=False),
    )
    got = {r.repository_path: (r.file_count, r.raw_url, r.token_expires) for r in folders.folder_rollup(df).collect()}
    assert got == {
        "log-a": (1, "https://raw/a?token=1", True),
        "log-b": (2, None, False),
        "log-c": (1, None, False),
        "log-d": (0, None, False),
        "log-e": (1, "https://raw/e?token=1", False),
    }
    local = {r.repository_path: r.file_count for r in folders.folder_rollup(df, include_dotfiles=False).collect()}
    assert local["log-c"] == 0 and local["log-b"] == 2
    url = folders.folder_rollup(df).where("repository_path = 'log-e'").first().url
    assert url == "https://github.com/me/public-logs/tree/dev/log-e"


def test_listings(spark, rows):
    folder = spark.createDataFrame(
        [(1, None), (2, " \n"), (3, "[]"), (4, '[{"name":"a","download_url":null},{"name":"b","download_url":"u"}]'), (5, "{oops")],
        "id int, listing string",
    )
    assert rows(listings.explode_listing(folder, "listing", "folder")) == [
        (1, False, False, None, None),
        (2, True, False, None, None),
        (3, True, False, None, None),
        (4, True, False, "a", None),
        (4, True, False, "b", "u"),
        (5, True, True, None, None),
    ]
    repo = spark.createDataFrame([(1, None), (2, '{"defaultBranch":"main","visibility":"private"}'), (3, "nope")], "id int, listing string")
    assert rows(listings.explode_listing(repo, "listing", "repository")) == [
        (1, False, False, None, None),
        (2, True, False, "main", "private"),
        (3, True, True, None, None),
    ]
    gist = spark.createDataFrame([(1, '{"files":{"a":{"raw_url":"u"},"b":{"raw_url":"v"}}}'), (2, "{}"), (3, None)], "gist_id int, listing string")
    files = listings.explode_listing(gist, "listing", "gist")
    assert rows(folders.gist_rollup(files)) == [(1, 2, None), (2, 1, None), (3, 1, None)]


def test_answers_of_all_shapes_in_one_column(spark, rows):
    answers = [
        (1, None), (2, " "), (3, "[]"), (4, '[{"name":"a","download_url":"u"},{"name":7},3,null,{"name":"b"}]'),
        (5, '{"name":"c","download_url":"v","type":"file"}'), (6, '{"message":"Not Found"}'), (7, '{"message":"x","status":404}'),
        (8, '{"message":"API rate limit exceeded"}'), (9, "{broken"), (10, '"text"'), (11, "null"), (12, '{"message":5}'),
        (13, "{}"), (14, '[{"name":"' + "x" * 300_000 + '"}]'), (15, '{"name":"a","name":"b"}'),
    ]
    df = spark.createDataFrame(answers, "id int, listing string")
    got = {}
    for r in listings.explode_answers(df, "listing").orderBy("id", "entry_no").collect():
        got.setdefault(r.id, []).append((r.shape, r.error, r.entry_no, r.bad_entry, r.name, r.download_url))
    none = (None, None, None, None)
    assert {i: got[i] for i in (1, 6, 7)} == dict.fromkeys((1, 6, 7), [("absent", None, *none)])
    assert {i: got[i] for i in (2, 3)} == dict.fromkeys((2, 3), [("folder", None, *none)])
    assert got[4] == [
        ("folder", None, 0, False, "a", "u"), ("folder", None, 1, True, None, None), ("folder", None, 2, True, None, None),
        ("folder", None, 3, True, None, None), ("folder", None, 4, False, "b", None),
    ]
    assert got[5] == [("file", None, 0, False, "c", "v")]
    assert got[8] == [("failed", "API rate limit exceeded", *none)]
    assert all(got[i] == [("malformed", None, *none)] for i in (9, 10, 11, 12, 13, 15))
    assert got[14][0][4] == "x" * 300_000
    assert listings.explode_answers(df.limit(0), "listing").count() == 0


CHUNK = "owner string, repository_name string, repository_path string, chunk_name string, content binary"


@pytest.mark.parametrize("by_folder", [False, True])
def test_archive_round_trip_and_replay(spark, rows, tmp_path, by_folder):
    base = str(tmp_path / "my archive")
    assert archive.read_listing(spark, base).count() == 0 and archive.read_archive(spark, base).count() == 0
    first = spark.createDataFrame([("me", "private-logs", "log-a", "a.part-00.log.txt", b"\x00ab"), ("me", "private-logs", "log-a", "a.part-01.log.txt", b"c")], CHUNK)
    second = spark.createDataFrame([("me", "public-logs", "log-b", "b.log.txt", b"xyz")], CHUNK)
    archive.write_archive(first, base, "w", 0, by_folder)
    archive.write_archive(second, base, "w", 1, by_folder)
    archive.write_archive(second, base, "w", 1, by_folder)
    expected = [("log-a", "a.part-00.log.txt", 3), ("log-a", "a.part-01.log.txt", 1), ("log-b", "b.log.txt", 3)]
    assert rows(archive.read_listing(spark, base), "repository_path", "chunk_name", "size_bytes") == expected
    assert rows(archive.read_archive(spark, base), "repository_path", "chunk_name", "size_bytes") == expected
    one = archive.read_folder(spark, base, "me", "private-logs", "log-a").orderBy("chunk_name")
    assert b"".join(bytes(r.content) for r in one.collect()) == b"\x00abc"
    assert archive.read_folder(spark, base, "me", "private-logs", "log-b").count() == 0


def test_half_written_batch_is_not_visible(spark, tmp_path):
    base = str(tmp_path)
    chunk = spark.createDataFrame([("me", "private-logs", "log-a", "a.log.txt", b"abc")], CHUNK)
    archive.write_archive(chunk, base, "w", 0)
    half = chunk.withColumnRenamed("repository_name", "repository").withColumn("size_bytes", F.lit(3).cast("bigint"))
    half.withColumn("layout", F.col("repository")).write.partitionBy("layout").parquet(f"{base}/content/writer=w/batch=1")
    assert archive.read_archive(spark, base).count() == 1


def test_calls_without_a_batch_add_to_the_archive(spark, rows, tmp_path):
    base = str(tmp_path)
    for name in ("log-a", "log-b"):
        archive.write_archive(spark.createDataFrame([("me", "private-logs", name, "x.log.txt", b"x")], CHUNK), base)
    assert rows(archive.read_listing(spark, base), "repository_path") == [("log-a",), ("log-b",)]


def test_broken_listing_is_an_error(spark, plan):
    listed = spark.createDataFrame([("me", "private-logs", "main", "log-a", "private", "{oops")], "owner string, repository_name string, branch string, repository_path string, visibility string, listing string")
    have = listings.explode_listing(listed, "listing", "folder")
    df = dedup.dedup_uploads(plan(upload(0), upload(1, at=1)), have)
    assert [(r.deduplicated, r.action, r.error is not None) for r in df.collect()] == [(False, "error", True)] * 2
    assert dedup.uploads_to_write(df).count() == 0
    row = folders.folder_rollup(have).first()
    assert row.malformed and row.file_count is None


def test_part_counts_agree_with_the_manifest(spark, plan, contents):
    uploads = plan(upload(0)).withColumn("size_bytes", F.lit(4 << 20).cast("bigint"))
    row = dedup.dedup_uploads(uploads, contents(), chunk_size=3 << 19, granularity=1 << 20).first()
    assert row.file_count == 2


def test_dedicated_repositories_are_written(spark, plan, rows):
    taken = spark.createDataFrame([("me", "log-a")], "owner string, name string")
    df = dedup.dedicated_to_write(plan(upload(0, shared=False), upload(1, "log-b", shared=False), upload(2, "log-c")), taken)
    assert rows(df, "repository_name", "repository_path") == [("log-a-1704067200000", None), ("log-b", None)]


def test_listing_stays_small_over_many_batches(spark, tmp_path, monkeypatch):
    from lograft.sources import snapshots

    base = str(tmp_path)
    log = archive.listing_log(spark, base)
    opened = []
    real = snapshots.SnapshotLog._read
    monkeypatch.setattr(snapshots.SnapshotLog, "_read", lambda self, *parts: opened.append(parts) or real(self, *parts))
    row = f"owner string, repository string, repository_path string, chunk_name string, size_bytes bigint, file_path string, writer string, batch bigint"
    assert row == archive.LISTING_SCHEMA
    per_batch, files = [], []
    for batch in range(36):
        rows = spark.createDataFrame([("me", "private-logs", f"log-{batch}-{i}", "x", 1, "f", "w", batch) for i in range(2)], row)
        added = log.write(rows.withColumn("bucket", F.lit(batch % 3)), *archive.KEY)
        opened.clear()
        log.commit(added, writer="w", batch=batch)
        per_batch.append(len(opened))
        log.compact(row, *archive.KEY)
        files.append(len(log.current().paths([batch % 3])))
    assert max(per_batch[24:]) <= max(per_batch[2:10]) and max(files) <= snapshots.SMALL_FILES + 1
    now = log.current()
    assert now.marks == {"w": 35} and log.read(row).count() == 72 and now.version > 36
    # Older snapshots are still there, and what later ones replaced is named once.
    assert log.read(row, version=10).count() < 72
    gone = log.removable(1, now.version)
    assert len(gone) == len(set(gone)) > 0 and not set(gone) & set(now.paths())
    alive = set(now.paths())
    written = {str(p) for p in tmp_path.rglob("*.parquet")}
    assert written == alive | set(gone)


def test_torn_pointers_and_second_writers(spark, tmp_path):
    from lograft.sources.snapshots import Conflict, Live, SnapshotLog

    log = SnapshotLog(spark, str(tmp_path))
    log.commit([Live(0, "a", 1)], writer="w", batch=3)
    # A writer that died while it made the next pointer, and one that died before the hint.
    (tmp_path / "versions" / "2").write_text("half")
    assert log.current().version == 1
    log.commit([Live(1, "b", 1)], writer="v", batch=1)
    (tmp_path / "versions" / "latest").unlink()
    assert log.current().paths() == ["a", "b"] and log.current().marks == {"w": 3, "v": 1}
    log.commit([Live(0, "c", 1)], ["a"])
    with pytest.raises(Conflict):
        log.commit([Live(0, "d", 1)], ["a"])
    assert log.current().paths() == ["b", "c"] and log.at(2).paths() == ["a", "b"] and log.at(9) is None


def test_a_replaced_batch_leaves_no_bodies(spark, rows, tmp_path):
    base = str(tmp_path)
    def chunk(name, body):
        return spark.createDataFrame([("me", "private-logs", name, "x.log.txt", body)], CHUNK)
    archive.write_archive(chunk("log-a", b"1"), base, "w", 0)
    archive.write_archive(chunk("log-b", b"2"), base, "w", 1)
    archive.write_archive(chunk("log-c", b"3"), base, "w", 0)
    assert rows(archive.read_archive(spark, base), "repository_path") == [("log-b",), ("log-c",)]
    archive.write_archive(chunk("log-d", b"4"), base, "w", 1, replace=False)
    assert rows(archive.read_archive(spark, base), "repository_path") == [("log-b",), ("log-c",), ("log-d",)]
    assert rows(archive.read_folder(spark, base, "me", "private-logs", "log-d"), "chunk_name") == [("x.log.txt",)]
