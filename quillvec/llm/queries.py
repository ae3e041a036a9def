"""The registered queries of these operators: each over its whole table, in the agreed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import (
    conversation_trie,
    exact_dedup,
    language_id,
    packing,
    private_spans,
    quality_rules,
    sampled_pieces,
    secret_scan,
    sharding,
    shingle_join,
    site_tree,
    suffix_dedup,
    token_alignment,
)
from quillvec.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.learn(docs))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans.digest(table(spark, sf_dir, "documents")).select(
        "doc_id", *(f"n_{k}" for k in private_spans.KINDS), "base_sha256", "spans"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op7_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.main_texts(table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_classes(table(spark, sf_dir, "documents"))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of ``conversations``; ``round_trip`` says whether the ids decode to the text."""
    turns = table(spark, sf_dir, "conversations")
    keys = ["conv_id", "turn", "role", "text"]
    return sampled_pieces.encode(turns, keys).select(
        "conv_id",
        "turn",
        "sample",
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        "log_prob",
        "perturbed",
        "inclusion",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.col("groups")
    return token_alignment.align(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        "n_best",
        "count_sum",
        F.when(groups == "", groups).otherwise(F.sha2(groups, 256)).alias("groups_sha256"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_trie.trie(*conversation_trie.rebuilt_conversations(turns))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_suffix_dedup,
        op3_language_id,
        op4_sharding,
        op5_private_spans,
        op6_quality_rules,
        op7_site_tree,
        op8_exact_dedup,
        op9_shingle_join,
        op10_sampled_pieces,
        op11_token_alignment,
        op12_conversation_trie,
        op13_secret_scan,
    )
}
