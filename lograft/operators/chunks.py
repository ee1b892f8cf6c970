"""Byte-range chunks of oversized files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lograft.constants import CHUNK_GRANULARITY, CHUNK_SIZE, LEAST_PART_DIGITS
from lograft.functions.digests import crc_before
from lograft.functions.naming import part_name, uploaded_name
from lograft.functions.sizes import ceil_div
from lograft.operators.catalogue import scan_log_files
from lograft.sources.bytechunks import byte_ranges, with_range_content


def part_bytes(chunk_size: int, granularity: int) -> int:
    """The size of a full chunk: rounded up to ``granularity``."""
    return -(-chunk_size // granularity) * granularity


def part_count(size: Column, chunk_size: int = CHUNK_SIZE, granularity: int = CHUNK_GRANULARITY) -> Column:
    """How many chunks a file is stored as; one up to ``chunk_size``."""
    parts = ceil_div(size, part_bytes(chunk_size, granularity))
    return F.when(size > chunk_size, parts).otherwise(F.lit(1)).cast("bigint")


def chunk_manifest(
    files: DataFrame, chunk_size: int = CHUNK_SIZE, granularity: int = CHUNK_GRANULARITY
) -> DataFrame:
    """One row per chunk: number, offset, length and name; no bodies are read.

    Files up to ``chunk_size`` stay whole. Every byte of a file is in a chunk,
    however many that takes; part numbers are as wide as the file needs.
    """
    size, full = F.col("size_bytes"), part_bytes(chunk_size, granularity)
    split = size > chunk_size
    last = part_count(size, chunk_size, granularity) - 1
    chunk = F.col("chunk_no")
    digits = F.greatest(F.lit(LEAST_PART_DIGITS), F.length(last.cast("string")))
    name = F.when(split, part_name(F.col("path"), chunk, digits)).otherwise(uploaded_name(F.col("path")))
    return files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk_no")).withColumns(
        {
            "offset": chunk * full,
            "length": F.when(split, F.least(F.lit(full), size - chunk * full)).otherwise(size),
            "chunk_name": name,
        }
    )


def scan_chunks(
    spark: SparkSession,
    root: str,
    chunk_bytes: int = CHUNK_SIZE,
    suffixes: Sequence[str] = (),
    exclude: Sequence[str] = (),
    content: bool = True,
) -> DataFrame:
    """All files below ``root`` in byte ranges: path, chunk_no, offset, length and, if asked for, content.

    Tasks list the tree, and names are judged before a body is opened; a file of
    any size is read by as many tasks as its ranges need.
    """
    ranges = byte_ranges(scan_log_files(spark, root, suffixes, exclude), chunk_bytes)
    return with_range_content(ranges) if content else ranges


def split_content(
    files: DataFrame, chunk_size: int = CHUNK_SIZE, granularity: int = CHUNK_GRANULARITY
) -> DataFrame:
    """Cut bodies that are already in a table; ``content`` becomes the chunk.

    Narrow: each body is sliced in the task that holds it. Files on storage are
    better read chunk by chunk (``lograft.sources.bytechunks``).
    """
    return chunk_manifest(files, chunk_size, granularity).withColumn("content", _range_of("content"))


def _range_of(column: str) -> Column:
    return F.substring(F.col(column), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))


def _covered(chunks: DataFrame, crc: Column | None = None) -> DataFrame:
    """One row per file: what its chunks cover, and the exclusive or of ``crc`` over them if that is given.

    Numbers are marked in words of 64 bits, so that a row stands for 64 chunks before the first shuffle; distinct ones,
    each counted by itself, would all be shuffled.
    """
    word, place = F.expr("shiftright(cast(chunk_no AS bigint), 6)"), F.expr("cast(chunk_no & 63 AS int)")
    marks = chunks.groupBy("path", "size_bytes", word.alias("_word")).agg(
        F.count("*").alias("n"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place)).alias("_marks"),
        F.min("chunk_no").alias("low"),
        F.max("chunk_no").alias("high"),
        F.sum("length").alias("covered"),
        F.max(F.col("offset") + F.col("length")).alias("end"),
        *([F.bit_xor(crc).alias("crc")] if crc is not None else []),
    )
    found = marks.groupBy("path", "size_bytes").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.bit_count("_marks")), F.lit(0)).cast("bigint").alias("distinct"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("covered").alias("covered"),
        F.max("end").alias("end"),
        *([F.bit_xor("crc").alias("crc")] if crc is not None else []),
    )
    whole = (
        (F.col("distinct") == F.col("n"))
        & (F.col("low") == 0)
        & (F.col("high") == F.col("n") - 1)
        & (F.col("covered") == F.col("size_bytes"))
        & (F.col("end") == F.col("size_bytes"))
    )
    return found.withColumn("whole", whole)


def check_coverage(chunks: DataFrame) -> DataFrame:
    """Files whose chunks leave a gap, overlap, repeat or miss the end; none when whole.

    Combined before the shuffle: lengths add up to the size, the last chunk ends
    at it, and the numbers are distinct and start at zero.
    """
    return _covered(chunks).where("not whole").drop("distinct", "whole")


def part_digests(chunks: DataFrame) -> DataFrame:
    """One small row per chunk: path, size_bytes, chunk_no, offset, its true length and the CRC-32 of its bytes; narrow."""
    return chunks.select(
        "path",
        "size_bytes",
        "chunk_no",
        "offset",
        F.octet_length("content").cast("bigint").alias("length"),
        F.crc32("content").alias("crc"),
    )


def file_digests(parts: DataFrame) -> DataFrame:
    """One row per file: number of parts, bytes, whether they are whole, and the CRC-32 of the file they make.

    Takes :func:`part_digests`. The CRC of the file is put together from those of its parts, combined before the
    shuffle, so no task sees more than a number of each part; without meaning if the parts are not whole.
    """
    behind = F.greatest(F.col("size_bytes") - F.col("offset") - F.col("length"), F.lit(0))
    found = _covered(parts, crc_before(F.col("crc"), behind))
    return found.select("path", "n", F.col("covered").alias("bytes"), F.col("whole"), "crc")


def verify_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file with chunks: their number and bytes, whether they are whole, and the same as the file.

    ``chunks`` hold what was stored, ``files`` the bodies (``path``, ``content``). Only digests
    meet: that of each file, and the one that its chunks add up to.
    """
    own = files.select("path", F.crc32("content").alias("_crc"), F.octet_length("content").alias("_size"))
    found = file_digests(part_digests(chunks)).join(own, "path")
    same = F.col("whole") & (F.col("crc") == F.col("_crc")) & (F.col("bytes") == F.col("_size"))
    return found.select("path", "n", "bytes", "whole", same.alias("same"))


def wrong_parts(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Parts that are not what they should be, one row each: path, chunk_no and ``lost``, ``extra``, ``swapped`` or ``changed``.

    Both sides are :func:`part_digests`, the expected ones kept from when the file was cut. A part is swapped if it
    is what another part of its file should be. Parts of one number are compared with each of that number.
    """
    keys = ["path", "chunk_no"]
    have = stored.select(*keys, F.col("length").alias("_length"), F.col("crc").alias("_crc"), F.lit(True).alias("_have"))
    want = expected.select(*keys, "length", "crc", F.lit(True).alias("_want"))
    differ = ~(F.col("crc").eqNullSafe(F.col("_crc")) & F.col("length").eqNullSafe(F.col("_length")))
    both = have.join(want, keys, "full").where(differ)
    others = expected.select("path", F.col("length").alias("_length"), F.col("crc").alias("_crc"), F.lit(True).alias("_other"))
    state = (
        F.when(F.col("_have").isNull(), "lost")
        .when(F.col("_want").isNull(), "extra")
        .when(F.col("_other"), "swapped")
        .otherwise("changed")
    )
    return both.join(others.distinct(), ["path", "_length", "_crc"], "left").select(*keys, state.alias("state"))
