"""The training-data operators as queries over the given tables, with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lograft.llm import (
    chat,
    fingerprints,
    language,
    mixing,
    near_duplicates,
    neighbours,
    packing,
    quality,
    reweighting,
    rules,
    sharding,
    spelling,
    tokens,
)
from lograft.llm.common import document_remainder, table

SHARDS = tuple(f"shard-{i:02d}" for i in range(16))
SLOTS = 1601
COUNTED_TOKENIZER = "word_bpe_49k.json"
PACKED_TOKENIZER, PACKED_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.all_turns(table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.format_conversations(turns))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, SHARDS, "doc_id", slots=SLOTS).select("doc_id", "source", "slot", "shard")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(COUNTED_TOKENIZER), limit=2048)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return neighbours.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(document_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path(PACKED_TOKENIZER),
        public_tokenizers.path(PACKED_RANKS),
        window=2048,
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *rules.MEASURES, "base_failed", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.train_dictionaries(docs))
    held_out = F.coalesce(document_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reweighting.resample(docs, table(spark, sf_dir, "benchmark").select("text"), share=10, least_words=20, seed=2024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_sharding,
        op3_near_duplicates,
        op4_token_counts,
        op5_nearest_neighbours,
        op6_mix_sources,
        op7_quality_scores,
        op8_packing,
        op9_quality_rules,
        op10_language_id,
        op11_fingerprints,
        op12_spelling_variants,
        op13_target_resampling,
    )
}
