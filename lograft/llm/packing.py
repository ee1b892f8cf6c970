"""Operator 8: token sequences of fixed length by best-fit decreasing."""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from lograft.llm.common import buffers, cut_slices
from lograft.session import stored

BATCH_BYTES = 2 << 20
# Pieces that one task packs together; there are as many blocks as that takes.
PIECES_PER_BLOCK = 4096
END_ID = 1
# Below U+0280 both libraries split words alike; a text with any later character goes the slow way.
FIRST_RARE_BYTE = 0xCA


@lru_cache(maxsize=2)
def _encoders(json_path: str, ranks_path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    if not ranks_path:
        return exact, None, frozenset()
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    special = {t.content: i for i, t in exact.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return exact, fast, frozenset(special)


def token_ids(texts: pa.Array, json_path: str, ranks_path: str | None = None) -> Iterator[np.ndarray]:
    """Ids of each whole text as the ``tokenizers`` file gives them, special strings included.

    ``ranks_path`` names the same vocabulary as ranks, which another library encodes
    several times as fast with equal results; it is used for texts of Latin letters only,
    and where it refuses one (very long runs of white space) the exact one takes over.
    """
    exact, fast, special = _encoders(json_path, ranks_path)
    body, offsets = buffers(texts)
    late = np.concatenate([[0], np.cumsum(body >= FIRST_RARE_BYTE)])
    rare = late[offsets[1:]] > late[offsets[:-1]]
    for i, slow in enumerate(rare):
        text = body[offsets[i] : offsets[i + 1]].tobytes().decode()
        ids = None
        if fast is not None and not slow:
            try:
                ids = fast.encode(text, allowed_special=special, disallowed_special=())
            except ValueError:  # its pattern has run out of stack
                ids = None
        if ids is None:
            ids = exact.encode(text, add_special_tokens=False).ids
        yield np.array(ids, "<u4")


PIECE = "start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, window: int = 2048, end_id: int = END_ID
) -> DataFrame:
    """Pieces of documents: full windows first, then the rest; ids stay in the task, their CRC goes on.

    A document is its ids and ``end_id``. NULL and empty texts are just ``end_id``.
    """
    schema = StructType([docs.schema["doc_id"]])
    for one in docs.sparkSession.createDataFrame([], PIECE).schema:
        schema = schema.add(one)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            for part in cut_slices(batch, "text", BATCH_BYTES):
                rows, starts, sizes, crcs, totals = [], [], [], [], []
                for row, ids in enumerate(token_ids(part.column("text"), json_path, ranks_path)):
                    ids = np.concatenate([ids, end])
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append(row)
                        starts.append(start)
                        sizes.append(len(piece))
                        crcs.append(zlib.crc32(piece.tobytes()))
                        totals.append(len(ids))
                numbers = [pa.array(x, pa.int64()) for x in (starts, sizes, crcs, totals)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), *numbers], names=schema.names
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the tightest that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node and not self.filled[node]:
            self.filled[node] = True
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, window) of the smallest capacity that is at least ``size``, or None."""
        node = self.leaves + size
        if not self.filled[node]:
            while node > 1 and (node & 1 or not self.filled[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.filled[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.windows[capacity].pop()
        if not self.windows[capacity]:
            node = self.leaves + capacity
            self.filled[node] = False
            while node > 1 and not self.filled[node ^ 1]:
                node >>= 1
                self.filled[node] = False
        return capacity, window


def best_fit_decreasing(sizes: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of every piece; ``sizes`` come in falling order."""
    open_windows, placed, offsets, made = OpenWindows(window), [], [], 0
    for size in sizes:
        found = open_windows.take(size)
        if found is None:
            found = (window, made)
            made += 1
        capacity, number = found
        placed.append(number)
        offsets.append(window - capacity)
        if capacity > size:
            open_windows.put(capacity - size, number)
    return placed, offsets


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str | None = None,
    window: int = 2048,
    end_id: int = END_ID,
    pieces_per_block: int = PIECES_PER_BLOCK,
) -> DataFrame:
    """One row per piece: its document and place there, and its sequence and place there.

    Needs ``doc_id`` and ``text``; other columns are left out. Repeated documents are
    packed as often as they stand; NULL ids are kept. An empty table gives an empty result.

    Texts stay in the tasks that read them; small rows for the pieces are written once
    and dealt out to blocks of a few thousand by a hash of the piece and its row number there,
    so no source, document or number of equal rows makes a block large. Each block is packed by
    itself, largest pieces first; what blocks lose against one pack over all is at most a partly
    filled window each or so. Ties are broken by id and start, so a task that runs again gives
    equal sequences, and so does a rerun that reads its input in equal partitions.
    """
    pieces = stored(cut_pieces(docs, json_path, ranks_path, window, end_id), "pieces")
    blocks = max(1, -(-pieces.count() // pieces_per_block))
    # Equal pieces are told apart by where they stand in the written table, which no lost executor changes.
    row = F.xxhash64("doc_id", "start", "ids_crc32", F.substring("_metadata.file_name", 1, 10), "_metadata.row_index")
    dealt = (
        pieces.withColumn("__block", F.pmod(row, F.lit(blocks)))
        # Several blocks a task, as many as the session's shuffle settings give: millions of blocks are not millions of tasks.
        .repartition("__block")
        .sortWithinPartitions("__block", F.desc("length"), "doc_id", "start", "ids_crc32")
    )
    schema = StructType(list(pieces.schema.fields)).add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            block = rows.column("__block")[0].as_py()
            placed, offsets = best_fit_decreasing(rows.column("length").to_pylist(), window)
            # Sequences are numbered by block; one block has fewer than 2^32 of them.
            numbers = (block << 32) + np.array(placed, np.int64)
            rows = rows.drop_columns("__block").append_column("sequence_id", pa.array(numbers))
            return rows.append_column("offset", pa.array(offsets, pa.int64())).combine_chunks().to_batches()[0]

        for batch in batches:
            blocks_here = batch.column("__block").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(blocks_here)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[0].column("__block")[0] != batch.column("__block")[lo]:
                    yield packed()
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed()

    return dealt.mapInArrow(run, schema)


def sequence_fill(packed: DataFrame, window: int = 2048) -> DataFrame:
    """Tokens and padding over all sequences; combined before the shuffle."""
    sequences = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return sequences.agg(
        F.count("*").alias("n_sequences"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.lit(window) - F.col("n")).alias("n_padding"),
    )
