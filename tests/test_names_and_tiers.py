import pytest
from pyspark.sql import functions as F

from lograft.constants import CHUNK_SIZE, MIB, SMALL_TIER_LIMIT
from lograft.functions import naming, sizes, text
from lograft.operators import names, strategy

NAMES = [
    ("/home/user/test.log", "home-user-test.log", "home-user-test.log.txt", "log-home-user-test"),
    ("var/log/app/error.log", "var-log-app-error.log", "var-log-app-error.log.txt", "log-var-log-app-error"),
    ("var\\log\\app\\error.log", "var-log-app-error.log", "var-log-app-error.log.txt", "log-var-log-app-error"),
    ("./logs/app.log", ".-logs-app.log", ".-logs-app.log.txt", "log-.-logs-app"),
    ("///home/user/test.log", "home-user-test.log", "home-user-test.log.txt", "log-home-user-test"),
    ("/var/log/error.txt", "var-log-error.txt", "var-log-error.txt.log.txt", "log-var-log-error.txt"),
    ("/home/user/test.log.txt", "home-user-test.log.txt", "home-user-test.log.txt", "log-home-user-test.log.txt"),
    ("/var/tmp/app-output", "var-tmp-app-output", "var-tmp-app-output.log.txt", "log-var-tmp-app-output"),
    (".log", ".log", ".log.txt", "log-"),
    ("a.log.log", "a.log.log", "a.log.log.txt", "log-a.log"),
    ("a.log.log.txt", "a.log.log.txt", "a.log.log.txt", "log-a.log.log.txt"),
    ("a.log\n", "a.log\n", "a.log\n.log.txt", "log-a.log\n"),
]


def test_archive_names(spark, rows):
    df = names.assign_archive_names(spark.createDataFrame([(n[0],) for n in NAMES], "path string"))
    assert rows(df, "path", "normalized", "uploaded_name", "repo_name") == sorted(NAMES)
    assert rows(df.where("gist_name <> uploaded_name")) == []


def test_default_description(spark):
    df = spark.createDataFrame([("/a/b.log", None), ("a\\b.log", ""), ("/a/b.log", "mine")], "path string, d string")
    got = [r[0] for r in df.select(naming.description_for(F.col("path"), F.col("d"))).collect()]
    assert got == ["Log file: b.log", "Log file: a\\b.log", "mine"]


def test_clashes_keep_every_path(spark, rows):
    paths = ["/a/b.log", "/a-b.log", "a\\b.log", "/c.log", "/a/b.log"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(names.name_clashes(df)) == [("log-a-b", 3, "/a-b.log", "a\\b.log")]
    assert [r[1] for r in rows(names.clash_members(df))] == ["/a-b.log", "/a/b.log", "a\\b.log"]


SIZES = [
    (0, "0 B"),
    (500, "500 B"),
    (1023, "1023 B"),
    (1024, "1.00 KB"),
    (1152, "1.13 KB"),
    (1536, "1.50 KB"),
    (1945, "1.90 KB"),
    (1048575, "1024.00 KB"),
    (2**20, "1.00 MB"),
    (2**30, "1.00 GB"),
    (2**40, "1.00 TB"),
    (2**50, "1024.00 TB"),
    (2**63 - 1, "8388608.00 TB"),
]


def test_readable_size(spark):
    df = spark.createDataFrame(SIZES, "n bigint, text string")
    assert df.where(sizes.readable_size(F.col("n")) != F.col("text")).count() == 0


@pytest.mark.parametrize(
    "size, kind, split, chunks",
    [
        (0, "gist", False, None),
        (SMALL_TIER_LIMIT - 1, "gist", False, None),
        (SMALL_TIER_LIMIT, "gist", False, None),
        (SMALL_TIER_LIMIT + 1, "repo", False, 1),
        (CHUNK_SIZE - 1, "repo", False, 1),
        (CHUNK_SIZE, "repo", False, 1),
        (CHUNK_SIZE + 1, "repo", True, 2),
        (500 * MIB, "repo", True, 5),
    ],
)
def test_tier_boundaries(spark, size, kind, split, chunks):
    df = strategy.classify_strategy(spark.createDataFrame([("x", size)], "path string, size_bytes bigint"))
    row = df.first()
    assert (row.type, row.needs_split, row.num_chunks) == (kind, split, chunks)
    assert (row.chunk_size is None) == (kind == "gist")
    if split:
        assert row.reason == f"File exceeds Gist limit, will be split into {chunks} chunks"


# Published sizes in MB (encoded) and their chunk counts.
@pytest.mark.parametrize("mb, chunks", [(133.74, 2), (136.44, 2), (270.18, 3), (405.26, 5), (675.44, 7)])
def test_published_chunk_counts(spark, mb, chunks):
    df = spark.createDataFrame([("x", int(mb * MIB))], "path string, size_bytes bigint")
    assert strategy.classify_strategy(df).first().num_chunks == chunks


def test_trim_takes_all_white_space(spark):
    df = spark.createDataFrame([("\ufeff\u00a0\t a b\u2003\n\u3000",), ("\u0085x",)], "s string")
    assert [r[0] for r in df.select(text.js_trim(F.col("s"))).collect()] == ["a b", "\u0085x"]


def test_drop_first(spark):
    df = spark.createDataFrame([("## 1.2 a ## 1.2", "## 1.2"), ("b", "x")], "s string, l string")
    assert [r[0] for r in df.select(text.drop_first(F.col("s"), F.col("l"))).collect()] == [" a ## 1.2", "b"]
