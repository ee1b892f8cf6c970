"""Digests put together from parts, and failures and URLs in files that are read in ranges."""

import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lograft.functions.digests import crc_before
from lograft.operators import changelog, chunks, log_scan

FILES = "path string, size_bytes bigint, content binary"


@pytest.fixture
def bodies(spark):
    made = {f"/b/{n}.log": os.urandom(n) for n in (0, 1, 9, 10, 11, 20, 21, 57)} | {"/b/same.log": b"ab" * 30}
    return made, spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in made.items()], FILES)


def test_crc_moved_past_bytes(spark):
    head = b"some head"
    for n in (0, 1, 2, 255, 4096, 1_000_003, 10_000_000):
        row = spark.range(1).select(crc_before(F.lit(zlib.crc32(head)), F.lit(n).cast("bigint")).alias("x")).first()
        assert row.x ^ zlib.crc32(bytes(n)) == zlib.crc32(head + bytes(n))


def test_digest_of_a_file_from_its_parts(bodies):
    made, df = bodies
    parts = chunks.part_digests(chunks.split_content(df, 10, 1))
    got = {r.path: (r.whole, r.bytes, r.crc) for r in chunks.file_digests(parts).collect()}
    assert got == {p: (True, len(b), zlib.crc32(b)) for p, b in made.items()}


def test_wrong_parts_are_told_by_their_numbers(spark, bodies, rows):
    _, df = bodies
    expected = chunks.part_digests(chunks.split_content(df, 10, 1)).where("path in ('/b/57.log', '/b/21.log', '/b/20.log')")
    at = lambda path, n: (F.col("path") == path) & (F.col("chunk_no") == n)
    swapped = F.when(at("/b/57.log", 0), 1).when(at("/b/57.log", 1), 0).when(at("/b/20.log", 1), 7).otherwise(F.col("chunk_no"))
    stored = expected.where(~at("/b/21.log", 1)).withColumn("crc", F.when(at("/b/57.log", 4), 5).otherwise(F.col("crc")))
    stored = stored.withColumn("chunk_no", swapped.cast("bigint"))
    assert rows(chunks.wrong_parts(stored, expected)) == [
        ("/b/20.log", 1, "lost"), ("/b/20.log", 7, "extra"), ("/b/21.log", 1, "lost"),
        ("/b/57.log", 0, "swapped"), ("/b/57.log", 1, "swapped"), ("/b/57.log", 4, "changed"),
    ]
    assert chunks.wrong_parts(expected, expected).count() == 0


def test_a_swap_of_whole_parts_is_seen(bodies):
    made, df = bodies
    cut = chunks.split_content(df, 10, 1)
    other = F.when(F.col("chunk_no") < 2, 1 - F.col("chunk_no")).otherwise(F.col("chunk_no"))
    swapped = cut.where("path = '/b/57.log'").withColumns({"chunk_no": other, "offset": other * 10})
    row = chunks.verify_chunks(swapped, df).first()
    assert row.whole and not row.same
    assert chunks.verify_chunks(cut, df).where("NOT same").count() == 0


PHRASES = [
    "ENOSPC: full", "fatal: No SPACE left on Device", "Name already exists", "HTTP 404", "couldn't find remote ref x",
    "  https://github.com/me/repo-1\t\r", "https://github.com/me/repo/tree", "https://gist.github.com/me/9 ", "https://gist.github.com/",
]


@pytest.mark.parametrize("range_bytes", [64, 1000, 1 << 20])
def test_lines_that_cross_borders_are_found_once(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    expected, uses = {}, {}
    for n in range(4):
        lines = []
        for _ in range(60):
            lines.append("x" * rng.randint(0, 90) + " ü")
            if n and rng.random() < 0.4:
                lines.append(rng.choice(PHRASES))
        (tmp_path / f"{n}.log").write_text("\n".join(lines) + "\n" * (n % 2), newline="")
        failed = [x for x in lines if x in PHRASES[:5]]
        urls = [x.strip() for x in lines if x == PHRASES[5]]
        expected[str(tmp_path / f"{n}.log")] = (
            any(x in PHRASES[:2] for x in lines), *(p in lines for p in PHRASES[2:5]),
            len(failed), failed[0] if failed else None, urls[0] if urls else None,
        )
        for x in lines:
            if x in (PHRASES[5], PHRASES[7]):
                uses[x.strip()] = uses.get(x.strip(), 0) + 1
    (tmp_path / "empty.log").write_bytes(b"")
    (tmp_path / "skip.txt").write_text("ENOSPC")
    expected[str(tmp_path / "empty.log")] = (False, False, False, False, 0, None, None)
    spark.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = log_scan.scan_failures(spark, str(tmp_path), (".log",)).drop("size_bytes").collect()
        targets = log_scan.scan_url_targets(spark, str(tmp_path), (".log",)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.path: tuple(r)[1:] for r in got} == expected
    assert {r.url: r.uses for r in targets} == uses


@pytest.mark.parametrize(
    "version, found",
    [
        (r"1\.2", True), (r"1.2(-rc)?", True), ("1.[23]", True), ("1.2(", False), ("1.2++", False),
        ("1.2)", False), ("(?P<x>1.2)", False), ("1.2{", False), (r"1\q2", False), ("[", False), ("(?:1.2)", True), ("1.2{1}", True),
    ],
)
def test_versions_as_patterns(spark, version, found):
    logs = spark.createDataFrame([(1, "# log\n\n## 1.2\n\nthe notes\n\n## 1.1\n\nold")], "doc_id long, body string")
    wanted = spark.createDataFrame([(1, version), (1, "1.1")], "doc_id long, version string")
    got = {r.version: r.notes for r in changelog.release_notes(logs, wanted, legacy=True).collect()}
    assert got["1.1"] == "old" and ("the notes" in got[version]) == found
    assert found or got[version] == f"Release {version}"


def test_numbers_of_chunks_are_marked_not_shuffled(spark):
    """Coverage is told from a row for 64 chunks; lost, repeated and missing numbers show."""
    made = {"whole": range(200), "gap": [*range(70), *range(71, 200)], "again": [*range(199), 3], "moved": range(1, 201)}
    made["none"] = [None, None]
    parts = [(p, 2000, n, 10 * i, 10, 0) for p, numbers in made.items() for i, n in enumerate(numbers)]
    df = spark.createDataFrame(parts, "path string, size_bytes long, chunk_no long, offset long, length long, crc long")
    covered = chunks._covered(df)
    plan = covered._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(path" in plan and not any("chunk_no" in line for line in plan.split("\n") if "hashpartitioning" in line)
    got = {r.path: (r.n, r["distinct"], r.whole) for r in covered.collect()}
    assert got == {"whole": (200, 200, True), "gap": (199, 199, False), "again": (200, 199, False), "moved": (200, 200, False), "none": (2, 0, False)}


def test_length_behind_a_part_is_worked_out_once(spark):
    """The plan names the length behind a part once, not for each bit of it."""
    df = spark.createDataFrame([(zlib.crc32(b"ab"), b"cde" * 1000)], "crc long, rest binary")
    found = df.select(crc_before(df["crc"], F.octet_length("rest").cast("bigint")).alias("moved"))
    assert found.first().moved ^ zlib.crc32(b"cde" * 1000) == zlib.crc32(b"ab" + b"cde" * 1000)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "getbit(" in plan and not re.search(r"getbit\([^,]*octet_length", plan)
