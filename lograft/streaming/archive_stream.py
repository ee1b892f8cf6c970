"""Incremental archive: a stream of requests into exactly-once folders."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lograft.constants import CHUNK_GRANULARITY, CHUNK_SIZE, REPO, SMALL_TIER_LIMIT
from lograft.operators.catalogue import stream_log_files
from lograft.operators.chunks import chunk_manifest, split_content
from lograft.operators.dedup import KEY, dedicated_to_write, dedup_uploads, uploads_to_write
from lograft.operators.planning import plan_uploads
from lograft.operators.repositories import uses_shared
from lograft.session import stored
from lograft.sources.archive import archive_contents, listing_bucket, read_listing, write_archive
from lograft.sources.bytechunks import with_range_content

UPLOAD = [*KEY, "path", "size_bytes"]


def asked_buckets(plan: DataFrame) -> list[int]:
    """The parts of the listing that can hold what a plan asks for; a small, fixed number at most."""
    folder = F.when(uses_shared(), F.col("repository_path"))
    asked = plan.where((F.col("type") == REPO) & ~F.col("dry_mode"))
    return [r[0] for r in asked.select(listing_bucket("owner", "repository_name", folder)).distinct().collect()]


def archive_batch(
    requests: DataFrame,
    files: DataFrame,
    archive: str,
    writer: str,
    batch: int,
    repositories: DataFrame | None = None,
    gist_limit: int = SMALL_TIER_LIMIT,
    chunk_size: int = CHUNK_SIZE,
    granularity: int = CHUNK_GRANULARITY,
) -> None:
    """Plan, deduplicate, cut and write one batch of requests.

    The plan is made from paths and sizes alone and stored, since several steps
    read it; bodies are read for the survivors only. With a ``content`` column in ``files`` they come from there, else each
    chunk is read from storage by its own row. The listing is committed at once for the whole
    batch, so what a replay finds of its own is whole, and is not written again.
    """
    spark = requests.sparkSession
    plan = stored(plan_uploads(requests, files, gist_limit, chunk_size), "plan")
    listing = read_listing(spark, archive, asked_buckets(plan))
    earlier = archive_contents(listing.where(F.col("repository_path").isNotNull()))
    # A dedicated repository that this very batch brought is no other's: it keeps its name, and is there already.
    own = (F.col("writer") == writer) & (F.col("batch") == batch)
    dedicated = listing.where(F.col("repository_path").isNull())
    taken = dedicated.where(~own).select("owner", F.col("repository").alias("name"))
    there = dedicated.where(own).select("owner", F.col("repository").alias("repository_name")).distinct()
    # Only the folders asked for, so a small batch shuffles little.
    asked = plan.where(uses_shared()).select(*KEY).distinct()
    known = earlier.join(asked, KEY, "left_semi")
    limits = (chunk_size, granularity)
    shared = uploads_to_write(dedup_uploads(plan, known, repositories, *limits)).select(*UPLOAD)
    # Small rows, stored so that the joins behind them run once.
    alone = dedicated_to_write(plan, taken).join(there, ["owner", "repository_name"], "left_anti")
    uploads = stored(shared.unionByName(alone.select(shared.columns)), "uploads")
    if "content" in files.columns:
        bodies = uploads.join(files.select("path", "content"), "path")
        chunks = split_content(bodies, *limits)
    else:
        chunks = with_range_content(chunk_manifest(uploads, *limits))
    write_archive(chunks, archive, writer, batch, replace=False)


def stream_archive(
    requests: DataFrame,
    files: DataFrame,
    archive: str,
    checkpoint: str,
    repositories: DataFrame | None = None,
    trigger: dict | None = None,
    **limits: int,
) -> StreamingQuery:
    """Start the stream; by default it works off what is there and ends.

    The archive listing is the dedup state, so there is no watermark and no state
    that grows in memory. A batch is identified by its checkpoint and its number,
    both of which survive a restart: a replay adds nothing to what it wrote, nor does a new
    stream over the same requests. What a batch opens of the listing does not grow with the number of batches.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        archive_batch(batch, files, archive, writer, batch_id, repositories, **limits)

    return (
        requests.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_files(
    spark: SparkSession,
    root: str,
    archive: str,
    checkpoint: str,
    owner: str,
    public: bool = False,
    suffixes: Sequence[str] = (),
    exclude: Sequence[str] = (),
    lateness_seconds: float = 3600,
    repositories: DataFrame | None = None,
    trigger: dict | None = None,
    **limits: int,
) -> StreamingQuery:
    """Archive every file that turns up below ``root``, once, under its own path; each file is a request of its own.

    Files are listed and read by tasks. The stream may bring a file again; the archive's listing is what tells
    whether it is there. As for any request, a file that has changed under its path is not archived again.
    """
    files = stream_log_files(spark, root, suffixes, exclude, lateness_seconds)
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        # Listed once, and numbered: the numbers stay as they are stored.
        found = batch.select("path", "size_bytes", "modified_at", F.monotonically_increasing_id().alias("request_id"))
        found = stored(found, "files")
        requests = found.select(
            "request_id",
            F.lit(owner).alias("owner"),
            "path",
            F.col("modified_at").alias("requested_at"),
            F.lit(public).alias("public"),
        )
        archive_batch(requests, found.select("path", "size_bytes"), archive, writer, batch_id, repositories, **limits)

    return (
        files.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def dedup_within_watermark(requests: DataFrame, delay: str = "1 hour") -> DataFrame:
    """For planned request streams without an archive: first per folder within ``delay``.

    Rows without a folder (gists, dedicated repositories) and dry runs are all kept, and claim nothing.
    """
    claims = F.col("repository_path").isNotNull() & F.col("repository_name").isNotNull()
    if "dry_mode" in requests.columns:
        claims &= ~F.coalesce("dry_mode", F.lit(False))
    own = requests.withColumn("_own", F.when(~claims, F.col("request_id")))
    kept = own.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark([*KEY, "_own"])
    return kept.drop("_own")


def stream_requests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New request files (Parquet) in a folder, as a stream."""
    return spark.readStream.schema(schema).parquet(folder)
