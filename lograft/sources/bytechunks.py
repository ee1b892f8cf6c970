"""``bytechunks``: files read as byte ranges, each range its own row.

A file of any size is read by as many tasks as it has chunks, and no task holds
more than one chunk at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

from lograft.constants import CHUNK_SIZE
from lograft.session import spread
from lograft.sources import catalogue
from lograft.sources.catalogue import Listing, open_filesystem

SCHEMA = "path string, chunk_no bigint, offset bigint, length bigint, content binary"
ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("chunk_no", pa.int64()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("content", pa.binary()),
    ]
)

BATCH_BYTES = 8 * 1024 * 1024
TASK_BYTES = 1024 * 1024 * 1024


def read_range(location: str, offset: int, length: int) -> bytes:
    """Seek and read; a file that has become shorter is an error, not a short chunk."""
    filesystem, path, _ = open_filesystem(location)
    with filesystem.open_input_file(path) as source:
        body = source.read_at(length, offset)
    if len(body) != length:
        raise OSError(f"{location}: wanted {length} bytes at {offset}, got {len(body)}")
    return body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), ARROW_SCHEMA)],
        schema=ARROW_SCHEMA,
    )


@dataclass
class Spans(InputPartition):
    """``(path, size, first chunk, end chunk)`` tuples that one task reads in turn."""

    spans: tuple

    def __post_init__(self):
        super().__init__(len(self.spans))


class ChunkReader(DataSourceReader):
    def __init__(self, root: str, chunk_bytes: int, task_bytes: int):
        self.files = Listing(root)
        self.chunk_bytes = chunk_bytes
        self.task_bytes = task_bytes

    def partitions(self):
        """Plan from file sizes, as Spark's own file sources do.

        A task gets up to ``taskBytes`` (at least one chunk), from one large file
        or several small ones. What is planned grows with the number of tasks and
        files, not with the number of chunks.
        """
        found = (
            row
            for part in self.files.partitions()
            for batch in self.files.read(part)
            for row in zip(batch.column("path").to_pylist(), batch.column("size_bytes").to_pylist(), strict=True)
        )
        per_task = max(1, self.task_bytes // self.chunk_bytes)
        parts, open_part, filled = [], [], 0
        for path, size in found:
            chunks = max(1, -(-size // self.chunk_bytes))
            for first in range(0, chunks, per_task):
                end = min(first + per_task, chunks)
                length = min(end * self.chunk_bytes, size) - first * self.chunk_bytes
                if open_part and filled + length > self.task_bytes:
                    parts.append(Spans(tuple(open_part)))
                    open_part, filled = [], 0
                open_part.append((path, size, first, end))
                filled += length
        if open_part or not parts:
            parts.append(Spans(tuple(open_part)))
        return parts

    def read(self, partition: Spans):
        rows, held = [], 0
        for location, size, first, end in partition.spans:
            for chunk_no in range(first, end):
                offset = chunk_no * self.chunk_bytes
                length = min(self.chunk_bytes, size - offset)
                if rows and held + length > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
                rows.append((location, chunk_no, offset, length, read_range(location, offset, length)))
                held += length
        if rows:
            yield _batch(rows)


class PushingChunkReader(ChunkReader):
    """One that takes filters on ``path`` into the listing; needs ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        on_path = [f for f in filters if getattr(f, "attribute", None) == ("path",)]
        self.files.conditions, left = catalogue.split_filters(on_path)
        return [f for f in filters if not any(f is p for p in on_path)] + left


class ByteChunks(DataSource):
    """``spark.read.format("bytechunks").option("chunkBytes", n).load(path)``.

    For a file or a folder whose listing is small, as the sizes of all files are planned
    with; ``scan_chunks`` lists in tasks and suits trees of any size. Options: ``chunkBytes`` (default 100 MiB); ``taskBytes``, how much one task
    reads when files are small (default 128 MiB); ``pushdown``, true to judge filters on ``path`` while listing.
    """

    @classmethod
    def name(cls) -> str:
        return "bytechunks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return (PushingChunkReader if pushing else ChunkReader)(
            self.options["path"],
            int(self.options.get("chunkBytes", CHUNK_SIZE)),
            int(self.options.get("taskBytes", 128 * 1024 * 1024)),
        )


def _fill(batches):
    for batch in batches:
        ranges = zip(*(batch.column(n).to_pylist() for n in ("path", "offset", "length")), strict=True)
        first, bodies, held = 0, [], 0
        for path, offset, length in ranges:
            if bodies and held + length > BATCH_BYTES:
                yield _filled(batch.slice(first, len(bodies)), bodies)
                first, bodies, held = first + len(bodies), [], 0
            bodies.append(read_range(path, offset, length))
            held += length
        if bodies:
            yield _filled(batch.slice(first, len(bodies)), bodies)


def _filled(rows: pa.RecordBatch, bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(bodies, type=pa.binary())], names=[*rows.schema.names, "content"]
    )


def with_range_content(manifest: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Add ``content`` to a chunk manifest whose ``path`` is a readable location.

    For catalogues that are tables: nothing is listed by the driver. The manifest
    is dealt out by chunk first, about ``task_bytes`` of content to a task, so the
    chunks of one file are read by many tasks.
    """
    schema = T.StructType([*manifest.schema.fields, T.StructField("content", T.BinaryType())])
    return spread(manifest, "length", task_bytes, "path", "chunk_no").mapInArrow(_fill, schema)


def byte_ranges(files: DataFrame, chunk_bytes: int = CHUNK_SIZE) -> DataFrame:
    """The ranges that a catalogue's files are read in: path, chunk_no, offset, length; no body is opened.

    An empty file has one empty range. Filter the catalogue or the ranges first and read
    (``with_range_content``) what is left.
    """
    last = F.greatest(F.lit(0), F.ceil(F.col("size_bytes") / chunk_bytes) - 1).cast("bigint")
    ranges = files.select("path", "size_bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no"))
    offset = F.col("chunk_no") * chunk_bytes
    length = F.least(F.lit(chunk_bytes), F.col("size_bytes") - offset)
    return ranges.select("path", "chunk_no", offset.alias("offset"), length.cast("bigint").alias("length"))


for _module in (catalogue, sys.modules[__name__]):
    try:
        cloudpickle.register_pickle_by_value(_module)
    except ValueError:
        pass
