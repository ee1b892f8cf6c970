"""The archive: chunk bodies laid out by folder, and a compact listing of them."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.constants import DEFAULT_BRANCH, PUBLIC_REPOSITORY
from lograft.sources.catalogue import plain_path
from lograft.sources.snapshots import SnapshotLog

CONTENT = "content"
LISTING = "listing"
DEDICATED = "dedicated"
KEY = ["owner", "repository", "repository_path"]
CHUNK_SCHEMA = (
    "owner string, repository_path string, chunk_name string, content binary, size_bytes bigint, "
    "writer string, batch bigint, repository string, layout string"
)
LISTING_SCHEMA = (
    "owner string, repository string, repository_path string, chunk_name string, "
    "size_bytes bigint, file_path string, writer string, batch bigint"
)
# The listing is laid out in so many parts for shared repositories, and as many for dedicated ones.
LISTING_BUCKETS = 64


def listing_bucket(owner: str, repository: str, path: str | Column) -> Column:
    """The part of the listing that holds a shared folder, or (without a path) an owner's dedicated repositories."""
    path = F.col(path) if isinstance(path, str) else path
    folder = F.pmod(F.xxhash64(owner, repository, path), F.lit(LISTING_BUCKETS))
    dedicated = F.pmod(F.xxhash64(owner), F.lit(LISTING_BUCKETS)) + LISTING_BUCKETS
    return F.when(path.isNotNull(), folder).otherwise(dedicated).cast("int")


def _part(base_path: str, kind: str, writer: str, batch: int) -> str:
    return os.path.join(base_path, kind, f"writer={writer}", f"batch={batch}")


def listing_log(spark: SparkSession, base_path: str) -> SnapshotLog:
    """The snapshots of the archive's listing."""
    return SnapshotLog(spark, os.path.join(base_path, LISTING))


def write_archive(
    chunks: DataFrame,
    base_path: str,
    writer: str = "batch",
    batch: int | None = None,
    by_folder: bool = False,
    replace: bool = True,
) -> None:
    """Write chunk bodies, then list them.

    ``chunks`` holds only folders that are new. Each ``(writer, batch)`` owns a
    directory of its own. Without a ``batch`` the call gets a fresh one; a retry names the batch
    it repeats, and replaces that as a whole, or (``replace`` false) adds to what it has brought.
    Writers do not see each other's unfinished batches: let one writer at a time add a folder. The listing is committed
    last, as a new snapshot (:mod:`lograft.sources.snapshots`):
    a batch that died half-way is not listed, and is written afresh when retried.
    Task failures are covered by Spark's output commit.

    Bodies are laid out by shared repository, those of dedicated ones (without a
    ``repository_path``) side by side. ``by_folder`` adds a directory per
    ``repository_path`` below it; that suits folders of many megabytes, while for
    millions of small ones the directories would cost more than the data. Either
    way the listing names the file of each chunk, for ``read_folder``.
    """
    spark = chunks.sparkSession
    log = listing_log(spark, base_path)
    named = batch is not None
    batch = uuid.uuid4().int >> 66 if batch is None else batch
    again = named and log.current().marks.get(writer, -1) >= batch
    # Bodies that are listed stay until the listing no longer names them.
    body_path = _part(base_path, CONTENT, f"{writer}.{uuid.uuid4().hex}" if again else writer, batch)
    layout = F.when(F.col("repository_path").isNull(), DEDICATED).otherwise(F.col("repository_name"))
    (
        chunks.select(
            "owner",
            F.col("repository_name").alias("repository"),
            "repository_path",
            "chunk_name",
            "content",
            F.octet_length("content").cast("bigint").alias("size_bytes"),
            layout.alias("layout"),
        )
        .write.mode("overwrite")
        .partitionBy("layout", *(["repository_path"] if by_folder else []))
        .parquet(body_path)
    )
    written = (
        spark.read.schema(CHUNK_SCHEMA)
        .option("basePath", os.path.join(base_path, CONTENT))
        .parquet(body_path)
        .select(
            *KEY,
            "chunk_name",
            "size_bytes",
            plain_path(F.col("_metadata.file_path")).alias("file_path"),
            F.lit(writer).alias("writer"),
            F.lit(batch).alias("batch"),
        )
    )
    written = written.withColumn("bucket", listing_bucket(*KEY))
    replaced: list[str] = []
    if again and replace:
        mine = (F.col("writer") == writer) & (F.col("batch") == batch)
        old = log.read(LISTING_SCHEMA).withColumn("bucket", listing_bucket(*KEY))
        buckets = [r.bucket for r in old.where(mine).select("bucket").distinct().collect()]
        replaced = log.current().paths(buckets)
        written = written.unionByName(old.where(F.col("bucket").isin(buckets) & ~mine))
    log.commit(log.write(written, *KEY), replaced, writer if named else None, batch)
    log.compact(LISTING_SCHEMA, *KEY)


def read_listing(
    spark: SparkSession, base_path: str, buckets: list[int] | None = None, version: int | None = None
) -> DataFrame:
    """One row per archived file, without bodies; empty if there is no archive yet.

    With ``buckets`` (:func:`listing_bucket`) only files of these parts are opened; no directory is listed.
    ``version`` reads an older snapshot.
    """
    return listing_log(spark, base_path).read(LISTING_SCHEMA, buckets, version)


def read_archive(spark: SparkSession, base_path: str) -> DataFrame:
    """Archived bodies. A filter on ``layout`` (the shared repository, or ``dedicated``) prunes directories.

    Bodies in files that the listing does not name (of a batch that died half-way or was replaced) are left out.
    """
    listed = read_listing(spark, base_path).select("file_path", "writer", "batch").distinct()
    path = os.path.join(base_path, CONTENT)
    try:
        bodies = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHUNK_SCHEMA)
    bodies = bodies.drop("writer", "batch").withColumn("file_path", plain_path(F.col("_metadata.file_path")))
    return bodies.join(listed, "file_path").drop("file_path")


def read_folder(spark: SparkSession, base_path: str, owner: str, repository: str, path: str) -> DataFrame:
    """The chunks of one folder, read from the few files that hold them."""
    wanted = (F.col("owner") == owner) & (F.col("repository") == repository) & (F.col("repository_path") == path)
    key = spark.range(1).select(*(F.lit(v).alias(k) for k, v in zip(KEY, (owner, repository, path), strict=True)))
    buckets = [r[0] for r in key.select(listing_bucket(*KEY)).collect()]
    rows = read_listing(spark, base_path, buckets).where(wanted).select("file_path").distinct().collect()
    if not rows:
        return spark.createDataFrame([], CHUNK_SCHEMA)
    reader = spark.read.schema(CHUNK_SCHEMA).option("basePath", os.path.join(base_path, CONTENT))
    return reader.parquet(*(row.file_path for row in rows)).where(wanted)


def archive_contents(listing: DataFrame) -> DataFrame:
    """A listing in the form that the dedup and roll-up operators take."""
    return listing.select(
        "owner",
        F.col("repository").alias("repository_name"),
        F.lit(DEFAULT_BRANCH).alias("branch"),
        "repository_path",
        F.when(F.col("repository") == PUBLIC_REPOSITORY, "public").otherwise("private").alias("visibility"),
        F.lit(True).alias("present"),
        F.lit(False).alias("malformed"),
        F.col("chunk_name").alias("name"),
        F.lit(None).cast("string").alias("download_url"),
    )
