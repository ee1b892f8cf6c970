"""Operator 4: token counts of whole texts."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lograft.llm.common import byte_lengths, cut_slices

# A batch for the tokenizer, in bytes of text.
BATCH_BYTES = 4 << 20
# Words whose counts a worker remembers; longer and later ones are encoded each time.
MEMO_WORDS = 300_000
MEMO_CHARS = 64


@lru_cache(maxsize=4)
def word_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def _word_counts(words: list[str], path: str) -> np.ndarray:
    """Tokens of each word; what the worker has counted before is not encoded again."""
    tokenizer, memo = word_tokenizer(path)
    unknown = [w for w in words if w not in memo]
    fresh = dict(zip(unknown, map(len, tokenizer.encode_batch_fast(unknown, add_special_tokens=False)), strict=True))
    counts = np.fromiter((memo[w] if w in memo else fresh[w] for w in words), np.int64, len(words))
    if len(memo) < MEMO_WORDS:
        memo.update((w, n) for w, n in fresh.items() if len(w) <= MEMO_CHARS)
    return counts


def lengths(texts: pa.Array, path: str) -> np.ndarray:
    """Token counts of a column of texts, for a tokenizer that drops white space.

    ASCII white space is a safe boundary there: no token, special string or
    composed character reaches over it, so a text has as many tokens as its
    pieces between such boundaries. Only different pieces are encoded.
    """
    pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = pieces.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    if not words:
        return np.zeros(len(texts), np.int64)
    counts = _word_counts(words, path)[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    offsets = pieces.offsets.to_numpy()
    return ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]]


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row, in place of the text.

    ``tokenizer_path``: a ``tokenizers`` file whose pre-tokenizer drops white
    space. A NULL or empty text has no tokens. Other columns are kept as they
    are; columns of the three names are replaced. Rows that repeat are counted
    each for itself, and an empty table gives an empty result.

    The scan's own partitions are kept, with no shuffle. Within a task the texts go to
    the tokenizer in batches of about equal bytes, and every text is split at
    white space, so the longest text needs no more memory than its own pieces.
    """
    names = ("n_bytes", "n_tokens", "over_limit")
    rest = [c for c in docs.columns if c != text and c not in names]
    columns = [docs[c] for c in rest]
    plain = docs.select(*columns, docs[text].alias("__text"))
    schema = docs.select(*columns).schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut_slices(batch, "__text", BATCH_BYTES):
                texts = part.column("__text")
                counts = lengths(texts, tokenizer_path)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(i) for i in range(len(rest))),
                        pa.array(byte_lengths(texts)),
                        pa.array(counts),
                        pa.array(counts > limit),
                    ],
                    names=[*rest, *names],
                )

    return plain.mapInArrow(run, schema)


def token_totals(counted: DataFrame, *keys: str) -> DataFrame:
    """Documents, tokens and documents over the limit by group; combined before the shuffle."""
    return counted.groupBy(*keys).agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("over_limit").cast("long")).alias("n_over"),
    )
