"""From raw documents to packed training sequences: quality, language, near duplicates, mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept;
its result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lograft.llm import language, mixing, near_duplicates, packing, quality
from lograft.llm.common import table
from lograft.llm.queries import PACKED_RANKS, PACKED_TOKENIZER
from lograft.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; it learns as in query 7."""
    model = quality.train(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    return quality.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; dictionaries come from the documents themselves."""
    found = language.identify(docs, language.train_dictionaries(docs))
    return found.where("accepted").select(*COLUMNS)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.keep_one(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixture(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    json_path, ranks_path = public_tokenizers.path(PACKED_TOKENIZER), public_tokenizers.path(PACKED_RANKS)
    return packing.pack(docs, json_path, ranks_path, window=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("n-gram Jaccard join", duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# The classifier and the language model are fitted, so SQL cannot give these rows; tests do it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
