"""Rows as text files, a directory for each key, written by the tasks that hold them."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lograft.sources.catalogue import open_filesystem, qualified

# Files in progress, in a directory that Spark's readers skip.
STAGING = "_temporary"
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


class TextFiles:
    """The files of one task, one open at a time: written aside and moved when whole, so no half file is ever in place."""

    def __init__(self, root: str, key: str, call: str):
        self.filesystem, self.base, _ = open_filesystem(root)
        self.key, self.call = key, call
        # Its own for each attempt of a task.
        self.aside = f"{staging(self.base, call)}/{uuid.uuid4().hex}"
        self.sink = self.value = None
        self.written = 0

    def append(self, value: object, body: bytes) -> None:
        if self.sink is None or value != self.value:
            self.close()
            self.sink, self.value = self.filesystem.open_output_stream(self.aside), value
        self.sink.write(body)

    def close(self) -> None:
        if self.sink is None:
            return
        self.sink.close()
        folder = f"{self.base}/{self.key}={NO_KEY if self.value is None else self.value}"
        self.filesystem.create_dir(folder)
        # An attempt that is repeated replaces what the first one brought.
        self.filesystem.move(self.aside, f"{folder}/part-{self.call}.txt")
        self.sink = None
        self.written += 1


def staging(base: str, call: str) -> str:
    return f"{base}/{STAGING}-{call}"


def write_text_files(rows: DataFrame, root: str, key: str, text: str, *order: str) -> None:
    """The rows of each key, in this order, as the lines of one file ``<key>=<value>/part-<call>.txt`` below ``root``.

    Laid out as ``partitionBy(key).text(root)`` does, for an integer key; a null text is an empty line, and a call adds
    to what is there. That writer suits fewer and larger files: without Hadoop's native library each file it creates on a
    local or mounted file system comes with a checksum file, and processes are started to set their permissions.
    """
    spark = rows.sparkSession
    root, call = qualified(spark, root), uuid.uuid4().hex
    filesystem, base, _ = open_filesystem(root)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TextFiles(root, key, call)
        for batch in batches:
            lines = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for value, run in groupby(lines, itemgetter(0)):
                files.append(value, b"".join(map(itemgetter(1), run)))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([files.written], pa.int64())], names=["files"])

    line = F.concat(F.coalesce(text, F.lit("")), F.lit("\n")).cast("binary").alias("_line")
    dealt = rows.select(key, line, *order).repartition(key).sortWithinPartitions(key, *order)
    filesystem.create_dir(staging(base, call))
    try:
        dealt.select(key, "_line").mapInArrow(write, "files bigint").write.format("noop").mode("overwrite").save()
    finally:
        filesystem.delete_dir(staging(base, call))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
