"""Operator 10: language by compression with a dictionary of each language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from lograft.llm.common import cut_slices, document_remainder, unit_hash

# A dictionary's raw content: this many documents of a language, this many characters of each.
DICTIONARY_DOCS = 100
DICTIONARY_CHARS = 500
LEVEL = 6
# Texts are coded in blocks, so that a long one does not become its own dictionary.
BLOCK_BYTES = 4096
BATCH_BYTES = 4 << 20
UNKNOWN = "und"
# Below this score two languages are too close: a lead of less than half a byte.
LEAST_SCORE = 0.6
# The lead over the second language must be this share of the coded bytes, and this many bytes in short texts. Chosen
# on labelled documents that are not held out (99 in 100 of those of 100 characters lead by 0.038) and mixed, random words.
LEAST_LEAD = 0.03
LEAST_LEAD_BYTES = 8


def train_dictionaries(docs: DataFrame, most_docs: int = DICTIONARY_DOCS) -> dict[str, bytes]:
    """Raw-content dictionaries of every non-NULL ``lang``, from documents that are not held out.

    Of each language the texts with a letter and the smallest hash of id count, ``most_docs`` of them,
    each with the ``DICTIONARY_CHARS`` characters from a hashed place in it on, in lower case: a bounded
    sample, about 50 kB a language, that no common head of all texts fills. Equal rows count once. Rows are
    ranked without their texts and cut before the shuffle; the ranking reads all of them.
    """
    learnt = docs.where(
        F.col("lang").isNotNull() & (document_remainder(F.col("doc_id"), 5) != 0) & F.col("text").rlike(r"\p{L}")
    ).select("lang", "doc_id", "text", F.xxhash64("text").alias("__text"))
    by_hash = Window.partitionBy("lang").orderBy("__hash", "doc_id", "__text")
    ranked = learnt.select("lang", "doc_id", "__text", unit_hash(F.lit("lang"), F.col("doc_id")).alias("__hash")).distinct()
    chosen = ranked.withColumn("__rank", F.row_number().over(by_hash)).where(F.col("__rank") <= most_docs)
    chosen = chosen.select("lang", "doc_id", "__text", "__rank")
    room = F.greatest(F.length("text") - DICTIONARY_CHARS, F.lit(0))
    start = F.floor(unit_hash(F.lit("place"), F.col("doc_id")) * (room + 1)).cast("int") + 1
    texts = (
        learnt.join(F.broadcast(chosen), ["lang", "doc_id", "__text"])
        .select("lang", "__rank", F.lower(F.substring("text", start, F.lit(DICTIONARY_CHARS))).alias("text"))
        .distinct()
        .collect()
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for row in texts:
        found.setdefault(row["lang"], []).append((row["__rank"], row["text"]))
    # What stands last is nearest to the text, so has the shortest distances: the smallest hashes.
    return {
        lang: "\n".join(t for _, t in sorted(set(parts), reverse=True)[:most_docs]).encode()
        for lang, parts in sorted(found.items())
    }


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard

    made = []
    for _, content in dictionaries:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        made.append(zstandard.ZstdCompressor(dict_data=raw, compression_params=parameters))
    return made


def coded_sizes(text: bytes, compressors: list) -> list[int]:
    """Bytes of the whole text under each dictionary, block by block."""
    blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], least_score: float = LEAST_SCORE) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``accepted`` to every row.

    The language whose dictionary makes the whole text, in lower case, smallest; of equals
    the first by code point. ``score`` is its share if each byte less counts e-fold
    (0 to 1; a half: two are level). Texts that are NULL or have no letter are
    ``und`` with score 0, so are all if no language was learnt. ``accepted``: not ``und`` and the lead over
    the second language is not narrow for the text's coded size. Only ``text`` is an input. Other columns are kept, columns of the three names are replaced.
    One pass over the scan's partitions; no shuffle.
    """
    plain = docs.drop("lang_pred", "score", "accepted")
    schema = plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(True)}).schema
    known = tuple(sorted(dictionaries.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(known)
        for batch in batches:
            for part in cut_slices(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
                raw = pc.utf8_lower(texts).cast(pa.binary()).to_pylist()
                langs, scores, wide = [], [], []
                for text, has_letter in zip(raw, lettered, strict=True):
                    if not has_letter or not known:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        wide.append(False)
                        continue
                    sizes = np.array(coded_sizes(text, compressors))
                    best = int(np.argmin(sizes))
                    langs.append(known[best][0])
                    scores.append(float(1.0 / np.exp(-(sizes - sizes[best]).clip(max=700).astype(float)).sum()))
                    least = max(LEAST_LEAD_BYTES, LEAST_LEAD * sizes[best])
                    wide.append(bool((np.delete(sizes, best) - sizes[best] >= least).all()))
                accepted = [s >= least_score and w for s, w in zip(scores, wide, strict=True)]
                columns = [*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                columns.append(pa.array(accepted, pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "lang_pred", "score", "accepted"])

    return plain.mapInArrow(run, schema)
