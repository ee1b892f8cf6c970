"""Operator 13: importance resampling towards a target distribution of hashed word runs.

Words are found by an Aho-Corasick automaton over the different words of a batch, each
between delimiters, with its CRC-32 and its length as payload. Payloads of adjacent words are
composed to the CRC-32 of the run that they make, without its bytes, which gives the run's bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lograft.llm.common import buffers, cut_slices
from lograft.session import stored

BUCKETS = 10_000
# Text of one automaton, in bytes; a longer text is scanned in parts of about this size.
BATCH_BYTES = 4 << 20
# Longer words stand in the scanned text as a short name, so an automaton is bounded by the batch.
LONG_WORD = 256

# Words are runs of digits, letters and all from U+0080 on; only A-Z change case.
_SPACE, _DELIMITER = 0x20, b" "
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else _SPACE
    for b in range(256)
)


def _advance_tables() -> np.ndarray:
    """``tables[p, i, b]``: what byte i with value b of a CRC becomes behind 2**p zero bytes."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(0xEDB88320), byte >> 1).astype(np.uint32)
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [(values >> 8) ^ byte[values & 255]]
    for _ in range(31):
        tables.append(_advance_once(tables[-1], tables[-1]))
    return np.stack(tables)


def _advance_once(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


ADVANCE = _advance_tables()


def advance(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved past as many zero bytes as its length says."""
    crc, lengths = crc.astype(np.uint32), lengths.astype(np.int64)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        moved = (lengths >> power) & 1 == 1
        crc[moved] = _advance_once(crc[moved], ADVANCE[power])
    return crc


def join_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from theirs and the length of the second."""
    return advance(first, lengths) ^ second.astype(np.uint32)


def _shortened(data: bytes) -> tuple[bytes, dict[bytes, bytes]]:
    """The text with long words replaced by names that no word has, and the words by their names."""
    words, parts, done = {}, [], 0
    array = np.frombuffer(data, np.uint8)
    gaps = np.flatnonzero(array == _SPACE)
    for n in np.flatnonzero(np.diff(gaps) > LONG_WORD + 1):
        start, end = int(gaps[n]) + 1, int(gaps[n + 1])
        name = words.setdefault(data[start:end], b"\x01%d" % len(words))
        parts += [data[done:start], name]
        done = end
    return b"".join([*parts, data[done:]]), {name: word for word, name in words.items()}


def scan(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and length of each word, in order, of a normal text that begins and ends with a delimiter."""
    data, long_words = _shortened(data)
    automaton = ahocorasick.Automaton()
    for word in set(data.split(_DELIMITER)) - {b""}:
        whole = long_words.get(word, word)
        payload = len(whole) << 32 | zlib.crc32(whole)
        automaton.add_word(f" {word.decode('latin-1')} ", payload)
    if not len(automaton):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    automaton.make_automaton()
    found = np.fromiter(chain.from_iterable(automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
    return (found[:, 1] & 0xFFFFFFFF).astype(np.uint32), found[:, 1] >> 32


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """The texts of a batch as normal bytes between delimiters, in parts of bounded size that cut no word.

    Yields the bytes, where in them each text begins, and the number of the first of these texts. Only
    a text longer than a batch is cut; then a part holds nothing else.
    """
    lengths = np.diff(offsets)
    if offsets[-1] <= 2 * BATCH_BYTES:
        body = data.tobytes().translate(NORMAL)
        joined = _DELIMITER.join(body[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]) if len(lengths) else np.empty(0, np.int64)
        yield _DELIMITER + joined + _DELIMITER, starts, 0
        return
    for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while True:
            end = min(start + BATCH_BYTES, stop)
            part = data[start:end].tobytes().translate(NORMAL)
            while end < stop and _DELIMITER not in part:
                end = min(end + BATCH_BYTES, stop)
                part = data[start:end].tobytes().translate(NORMAL)
            cut = len(part) if end == stop else part.rindex(_DELIMITER) + 1
            yield _DELIMITER + part[:cut] + _DELIMITER, np.zeros(1, np.int64), row
            start += cut
            if start >= stop:
                break


def features(texts: pa.Array, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of 1 to ``longest`` consecutive words of a column of texts: how many words, rows, CRC-32; by parts."""
    data, offsets = buffers(texts)
    held = (np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64))
    for body, starts, first in _parts(data, offsets):
        crc, length = scan(body)
        row = first + _rows_of_words(body, starts)
        # Runs may reach back over the border of a part of the same text.
        old = len(held[0])
        row, crc, length = (np.concatenate(pair) for pair in zip(held, (row, crc, length), strict=True))
        run = crc
        yield 1, row[old:], run[old:]
        for size in range(2, longest + 1):
            if len(row) < size:
                break
            space = np.full(len(run) - 1, zlib.crc32(_DELIMITER), np.uint32)
            spaced = join_crc(run[:-1], space, np.ones(len(space), np.int64))
            run = join_crc(spaced, crc[size - 1 :], length[size - 1 :])
            same = (row[: len(run)] == row[size - 1 :]) & (np.arange(size - 1, len(row)) >= old)
            yield size, row[size - 1 :][same], run[same]
        keep = max(len(row) - (longest - 1), 0)
        held = (row[keep:], crc[keep:], length[keep:])


def _rows_of_words(body: bytes, starts: np.ndarray) -> np.ndarray:
    """For each word of the body, in order, the text that it lies in."""
    space = np.frombuffer(body, np.uint8) == _SPACE
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    return np.searchsorted(starts, begins, side="right") - 1


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket``, ``n`` of the features of all rows; buckets without any are left out, NULL texts have none."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows in cut_slices(batch, "text", BATCH_BYTES):
                for _, _, crc in features(rows.column("text"), longest):
                    totals += np.bincount(crc % buckets, minlength=buckets)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["bucket", "n"])

    partial = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """What a feature of each bucket adds: 1000 times the log ratio of its smoothed shares, rounded down."""
    total, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * total / ((corpus.get(b, 0) + 1.0) * wanted)))
        for b in range(buckets)
    ]


def learn_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Gains of features that ``target`` holds more often than ``docs``; all texts of both tables count.

    Only ``buckets`` counts a table come to the driver.
    """
    both = (dict(map(tuple, bucket_counts(table, longest, buckets).collect())) for table in (docs, target))
    return gains(*both, buckets)


WEIGHED = "n_features bigint, n_words bigint, weight bigint"


def add_weights(docs: DataFrame, gain: list[int], longest: int = 1, text: str = "text") -> DataFrame:
    """Adds ``n_features``, ``n_words`` and ``weight`` (bigint) to every row; columns of these names are replaced.

    The weight is the mean gain of the row's features, rounded down; 0 without features, so for NULL texts too.
    """
    docs = docs.drop("n_features", "n_words", "weight")
    values = np.array(gain, np.int64)

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in cut_slices(batch, text, BATCH_BYTES):
                number, words, total = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
                for size, row, crc in features(rows.column(text), longest):
                    found = np.bincount(row, minlength=rows.num_rows)
                    number += found
                    words += found if size == 1 else 0
                    # Sums of whole numbers: exact in doubles.
                    gained = np.bincount(row, weights=values[crc % len(values)], minlength=rows.num_rows)
                    total += gained.astype(np.int64)
                mean = np.where(number > 0, total // np.maximum(number, 1), 0)
                added = [pa.array(number), pa.array(words), pa.array(mean)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *added], names=[*rows.schema.names, "n_features", "n_words", "weight"]
                )

    schema = docs.sparkSession.createDataFrame([], WEIGHED).schema
    return docs.mapInArrow(weigh, T.StructType([*docs.schema.fields, *schema.fields]))


def noise(key: Column, seed: int) -> Column:
    """1000 times a Gumbel value that depends on the key and the seed alone, rounded down (bigint)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((number + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``rank`` (bigint, from 1) in this order over all rows, without a task that sees them all.

    Rows are sorted in ranges, which are stored so that they stay as they are; equal rows may
    lie in several ranges, in any order. Only a count a range comes to the driver.
    """
    spark = rows.sparkSession
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.repartitionByRange(parts, *order, F.col("__row")).withColumn("__part", F.spark_partition_id())
    dealt = stored(dealt, "ranges")
    counts, before = [], 0
    for part, number in sorted(map(tuple, dealt.groupBy("__part").count().collect())):
        counts.append((part, before))
        before += number
    offsets = spark.createDataFrame(counts, "__part int, __before bigint")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__row"))
    return (
        dealt.join(F.broadcast(offsets), "__part")
        .withColumn("rank", (F.col("__before") + place).cast("bigint"))
        .drop("__part", "__before", "__row")
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = BUCKETS,
    share: int = 10,
    least_words: int = 20,
    seed: int = 2024,
) -> DataFrame:
    """Every document with its weight, score and, where it is drawn, its rank.

    Columns: doc_id, n_features, weight, score, rank (all bigint; rank NULL if undrawn). A score is the weight and
    a noise by ``doc_id``; of the documents of ``least_words`` and more, ``share`` percent (rounded down) of the
    highest scores are drawn, ties by smaller ``doc_id``, a missing one first. Repeated rows are
    rows like any others, so equal ones get ranks in a row. Empty tables give an empty result; an empty target has
    even shares. Other columns are left out.
    """
    gain = learn_gains(docs, target, longest, buckets)
    scored = add_weights(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), gain, longest)
    scored = scored.drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored, "weights")
    eligible = F.col("n_words") >= least_words
    # Scores are whole numbers in a range of some 10^5, whatever the number of documents.
    histogram = scored.where(eligible).groupBy("score").count().collect()
    wanted, cut, above = share * sum(r["count"] for r in histogram) // 100, None, 0
    for row in sorted(histogram, key=lambda r: -r.score):
        if above >= wanted:
            break
        cut, above = row.score, above + row["count"]
    chosen = eligible & (F.col("score") >= F.lit(cut)) if cut is not None else F.lit(False)
    ahead = ranked(scored.where(chosen), F.col("score").desc(), F.col("doc_id").asc())
    ahead = ahead.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("bigint"))
    return rest.unionByName(ahead).select("doc_id", "n_features", "weight", "score", "rank")
