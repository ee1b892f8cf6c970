"""Small helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed value: a word is a run of characters other than these.
SPACE = r" \t-\r"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_remainder(doc_id: Column, divisor: int) -> Column:
    """``crc32(doc_id as text) mod divisor``; NULL for a missing id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: 52 bits of an MD5."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def cut_slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of whole rows of about ``most_bytes`` of text each."""
    offsets = np.concatenate([[0], np.cumsum(byte_lengths(batch.column(column)))])
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield batch.slice(start, end - start)
        start = end


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text; 0 for NULL."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and each row's offsets into them; NULL becomes empty."""
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows with equal keys, over batch borders. Only for groups of bounded size."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != current:
                if rows:
                    yield current, rows
                current, rows = key, []
            rows.append(row)
    if rows:
        yield current, rows
