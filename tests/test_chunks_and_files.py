import hashlib
import os

import pytest
from pyspark.sql import functions as F

from lograft.constants import CHUNK_SIZE, CONSTANT_LINE, MIB, NUMBERED_LINE
from lograft.operators import audit, catalogue, chunks, corpus
from lograft.sources.bytechunks import ByteChunks, with_range_content
from lograft.sources.catalogue import CatalogueReader, qualified

FILES = "path string, size_bytes bigint"


def test_two_parts(spark, rows):
    df = chunks.chunk_manifest(spark.createDataFrame([("/t/chunk-source.log", 2 * MIB)], FILES), chunk_size=MIB)
    assert rows(df, "chunk_no", "offset", "length", "chunk_name") == [
        (0, 0, MIB, "t-chunk-source.part-00.log.txt"),
        (1, MIB, MIB, "t-chunk-source.part-01.log.txt"),
    ]


@pytest.mark.parametrize("size, parts", [(0, 1), (CHUNK_SIZE - 1, 1), (CHUNK_SIZE, 1), (CHUNK_SIZE + 1, 2), (100 * CHUNK_SIZE, 100)])
def test_part_counts(spark, size, parts):
    df = chunks.chunk_manifest(spark.createDataFrame([("a.log", size)], FILES))
    assert df.count() == parts and df.agg(F.sum("length")).first()[0] == size
    assert df.first().chunk_name == ("a.log.txt" if parts == 1 else "a.part-00.log.txt")


def test_part_numbers_are_as_wide_as_needed(spark):
    df = chunks.chunk_manifest(spark.createDataFrame([("a.log", 100 * CHUNK_SIZE + 1), ("b.log", 2 * CHUNK_SIZE)], FILES))
    assert df.where("path = 'a.log'").count() == 101 and df.agg(F.sum("length")).first()[0] == 102 * CHUNK_SIZE + 1
    names = {r.chunk_name for r in df.where("chunk_no in (1, 100)").collect()}
    assert names == {"a.part-001.log.txt", "a.part-100.log.txt", "b.part-01.log.txt"}


def test_chunks_are_rounded_up(spark, rows):
    df = chunks.chunk_manifest(spark.createDataFrame([("a", 25), ("b", 11), ("c", 12)], FILES), chunk_size=11, granularity=4)
    assert rows(df, "path", "chunk_no", "length") == [("a", 0, 12), ("a", 1, 12), ("a", 2, 1), ("b", 0, 11), ("c", 0, 12)]
    assert df.where("path = 'c'").first().chunk_name == "c.part-00.log.txt"


def test_cut_bodies_put_together_again(spark):
    bodies = {f"/b/{n}.log": os.urandom(n) for n in (0, 1, 9, 10, 11, 20, 21, 57)}
    df = spark.createDataFrame([(p, len(b), bytearray(b)) for p, b in bodies.items()], FILES + ", content binary")
    cut = chunks.split_content(df, chunk_size=10, granularity=1)
    assert chunks.check_coverage(cut).count() == 0
    again = {}
    for row in sorted(cut.collect(), key=lambda r: (r.path, r.chunk_no)):
        assert len(row.content) == row.length <= max(10, 0)
        again[row.path] = again.get(row.path, b"") + bytes(row.content)
    assert again == bodies
    assert chunks.check_coverage(cut.where("chunk_no <> 1")).count() == 4
    twice = cut.where("path = '/b/21.log'").withColumn("chunk_no", F.when(F.col("chunk_no") == 1, 0).otherwise(F.col("chunk_no")))
    assert chunks.check_coverage(twice).count() == 1
    checked = chunks.verify_chunks(cut, df).collect()
    assert len(checked) == len(bodies) and all(r.whole and r.same for r in checked)
    bad = cut.withColumn("content", F.when(F.col("chunk_no") == 1, F.reverse("content").cast("binary")).otherwise(F.col("content")))
    assert {r.path for r in chunks.verify_chunks(bad, df).where("not same").collect()} <= {"/b/11.log", "/b/20.log", "/b/21.log", "/b/57.log"}


@pytest.fixture
def tree(tmp_path):
    made = {
        "a.js": b"x\n" * 3,
        "empty.js": b"",
        "sub/no-newline.mjs": b"one\ntwo",
        "sub/bom.cjs": b"\xef\xbb\xbfone\ntwo\n",
        "sub/bom2.cjs": b"\xef\xbb\xbfone",
        "sub/cr.js": b"a\rb\r\nc",
        "sub/bad.js": b"\xff\xfe\n\xff",
        ".hidden.js": b"1\n2\n3",
        "_under/x.js": b"1\n2",
        "we ird+%20/ü.js": b"\n\n",
        "rebuild.js": b"\n",
        "node_modules/z.js": b"\n",
        "note.txt": b"\n",
    }
    for name, body in made.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    (tmp_path / "dir.js").mkdir()
    return str(tmp_path), made


def test_catalogue(spark, rows, tree):
    root, made = tree
    df = catalogue.scan_log_files(spark, root)
    assert rows(df, "relative_path", "size_bytes") == sorted((n, len(b)) for n, b in made.items())
    assert all(r.path == f"{root}/{r.relative_path}" for r in df.collect())
    some = catalogue.scan_log_files(spark, root, (".js",), ("node_modules", "build"), include_dotfiles=False)
    assert {r.relative_path for r in some.collect()} == {
        "a.js", "empty.js", "sub/cr.js", "sub/bad.js", "_under/x.js", "we ird+%20/ü.js"
    }
    assert catalogue.scan_log_files(spark, f"{root}/a.js").first().size_bytes == 6
    deep = spark.read.format("file_catalogue").option("fanOut", 1).load(root)
    assert deep.count() == len(made)


def test_no_file_goes_through_the_plan(tree):
    """Whatever the fan-out, the plan names directories alone; a flat folder is one that a task lists."""
    root, made = tree
    for fan_out in (1, 3, 100):
        reader = CatalogueReader(root, (), fan_out)
        parts = reader.partitions()
        assert all(p.file is None and os.path.isdir(p.directory) for p in parts)
        found = [name for p in parts for batch in reader.read(p) for name in batch.column("relative_path").to_pylist()]
        assert sorted(found) == sorted(made)
    assert CatalogueReader(f"{root}/a.js", (), 9).partitions()[0].file[1:4] == (f"{root}/a.js", "a.js", 6)


def test_many_directories_share_a_task(tmp_path):
    """A directory with many others makes no more tasks than asked for, and each is listed once."""
    for i in range(50):
        (tmp_path / f"part={i}" / "deep").mkdir(parents=True)
        (tmp_path / f"part={i}" / "x.txt").write_bytes(b"x" * i)
        (tmp_path / f"part={i}" / "deep" / "y.txt").write_bytes(b"")
    (tmp_path / "top.txt").write_bytes(b"")
    reader = CatalogueReader(str(tmp_path), (), 8)
    parts = reader.partitions()
    found = [name for p in parts for batch in reader.read(p) for name in batch.column("relative_path").to_pylist()]
    wanted = ["top.txt", *(f"part={i}/{n}" for i in range(50) for n in ("x.txt", "deep/y.txt"))]
    assert len(parts) == 8 and sorted(found) == sorted(wanted)


def test_locations_without_scheme(spark, tmp_path):
    assert qualified(spark, str(tmp_path)) == str(tmp_path) and qualified(spark, "s3://b/x") == "s3://b/x"


def test_scanned_chunks(spark, tree):
    root, made = tree
    got = chunks.scan_chunks(spark, root, 4, (".js", ".mjs"), ("node_modules",)).collect()
    wanted = {f"{root}/{n}": b for n, b in made.items() if n.endswith((".js", ".mjs")) and "node_modules" not in n}
    again = dict.fromkeys(wanted, b"")
    for row in sorted(got, key=lambda r: (r.path, r.chunk_no)):
        assert row.offset == row.chunk_no * 4 and row.length == len(row.content)
        again[row.path] += bytes(row.content)
    assert again == wanted and {r.path for r in got} == set(wanted)
    plain = chunks.scan_chunks(spark, root, 4, content=False)
    assert "content" not in plain.columns and "MapInArrow" not in plain._jdf.queryExecution().toString()


def test_line_counts(spark, tree):
    root, made = tree
    got = {r.relative_path: r.lines for r in audit.count_lines(spark, root).collect()}
    want = {
        n: b.decode("utf-8", "replace").count("\n") + 1
        for n, b in made.items()
        if n.endswith((".js", ".cjs", ".mjs")) and not any(x in n for x in ("node_modules", "build"))
    }
    assert got == want
    assert {r.relative_path for r in audit.line_limit_report(spark, root, max_lines=3).collect()} == {"a.js"}


def test_line_limit_is_exclusive(spark):
    df = spark.createDataFrame([("a", "\n" * 999), ("b", "\n" * 1000)], "name string, text string")
    assert [(r.name, r.lines) for r in audit.body_line_report(df).collect()] == [("b", 1001)]


def test_byte_chunks(spark, tree):
    root, made = tree
    spark.dataSource.register(ByteChunks)
    df = spark.read.format("bytechunks").option("chunkBytes", 4).option("taskBytes", 8).load(root)
    assert df.rdd.getNumPartitions() > 3
    again = {}
    for row in sorted(df.collect(), key=lambda r: (r.path, r.chunk_no)):
        assert row.offset == row.chunk_no * 4 and len(row.content) == row.length
        again[row.path] = again.get(row.path, b"") + bytes(row.content)
    assert again == {f"{root}/{n}": b for n, b in made.items()}


def test_ranges_of_a_manifest(spark, tmp_path):
    body = os.urandom(3 * MIB + 17)
    (tmp_path / "big.log").write_bytes(body)
    files = catalogue.scan_log_files(spark, str(tmp_path), (".log",)).select("path", "size_bytes")
    cut = with_range_content(chunks.chunk_manifest(files, chunk_size=MIB))
    parts = sorted(cut.collect(), key=lambda r: r.chunk_no)
    assert [p.length for p in parts] == [MIB, MIB, MIB, 17]
    assert hashlib.sha256(b"".join(bytes(p.content) for p in parts)).digest() == hashlib.sha256(body).digest()


@pytest.mark.parametrize("mb, lines, size", [(1, 5549, 1036556), (10, 55481, 10419322)])
def test_numbered_corpus(spark, mb, lines, size):
    df = corpus.generate_log_corpus(spark, [mb])
    assert tuple(corpus.corpus_summary(df, "target_mb").first()) == (mb, lines, size)
    assert df.where("line_no = 7").first().line == NUMBERED_LINE.replace("%LINE%", "7").rstrip("\n")
    assert df.select("line_no").distinct().count() == lines


def test_constant_corpus(spark):
    df = corpus.generate_log_corpus(spark, [1], numbered=False)
    assert df.count() == 13444 and df.select("line").distinct().first().line + "\n" == CONSTANT_LINE


@pytest.mark.parametrize("mb, part_lines", [(1, 700), (10, 1 << 16), (24, 9999)])
def test_corpus_files_are_exact_byte_for_byte(spark, tmp_path, mb, part_lines):
    sizes = spark.createDataFrame([(f"test-{mb}mb.log", mb * MIB), ("empty", 0)], "file string, target_bytes bigint")
    parts = corpus.write_corpus_files(sizes, str(tmp_path / "corpus"), "file", part_lines=part_lines).orderBy("part").collect()
    n = -(-mb * MIB // len(NUMBERED_LINE))
    expected = "".join(NUMBERED_LINE.replace("%LINE%", str(i)) for i in range(1, n + 1)).encode()
    assert [r.part for r in parts] == list(range(-(-n // part_lines))) and {r.file for r in parts} == {f"test-{mb}mb.log"}
    whole = b""
    for r in parts:
        (one,) = (tmp_path / "corpus" / f"file=test-{mb}mb.log" / f"part={r.part}").glob("*.txt")
        assert r.offset == len(whole) and r.length == one.stat().st_size
        whole += one.read_bytes()
    assert whole == expected


@pytest.mark.parametrize("template", ["ä %LINE% %LINE%\n", "constant\n"])
def test_bytes_before_counts_all_digits(spark, template):
    got = spark.range(0, 12_000).select("id", corpus.bytes_before(F.col("id"), template).alias("n")).orderBy("id").collect()
    total = 0
    for row in got:
        total += len(template.replace("%LINE%", str(row.id)).encode()) if row.id else 0
        assert row.n == total
    big = spark.range(1).select(corpus.bytes_before(F.lit(10**15).cast("bigint"), "%LINE%\n")).first()[0]
    assert big == 10**15 + sum(9 * 10 ** (d - 1) * d for d in range(1, 16)) + 16


def test_corpus_template_has_to_be_one_line(spark, tmp_path):
    sizes = spark.createDataFrame([("a", 10)], "file string, target_bytes bigint")
    for template in ("no end", "two\nlines\n"):
        with pytest.raises(ValueError):
            corpus.write_corpus_files(sizes, str(tmp_path / "x"), "file", template)
