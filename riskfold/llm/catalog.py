"""Registered queries of the subpackage, ``opN_<name>(spark, sf_dir)``, and
their DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm import (
    bpe, conversation_repair, exact_dedup, line_dedup, minhash_dedup, mixing, pii, prefix_trie, quality_classifier, quality_rules, sharding, sql,
    suffix_dedup, warc_store)
from riskfold.llm.common import stage_folder
from riskfold.sources.tables import read_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of all pages, read it back, and report its records."""
    import uuid

    folder = f"{stage_folder(spark)}/archive-{uuid.uuid4().hex}"
    warc_store.write_archive(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), folder)
    return warc_store.record_fields(warc_store.read_records(spark, folder))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), words=3, percent=85)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"]))
    return mixed.select("doc_id", F.col("__llm_size").alias("size"), "source_size", "target",
                        F.col("__llm_taken").alias("taken"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op7_pii(spark: SparkSession, sf_dir: str, key: bytes = b"set a secret key for each corpus") -> DataFrame:
    return pii.replace_entities(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), key)


def op8_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    model = quality_classifier.fit(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    scored = quality_classifier.with_score(docs, model, "score")
    return scored.select("doc_id", quality_classifier.is_held_out().alias("held_out"), "score",
                         (F.col("score") >= quality_classifier.KEEP_AT).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]),
                                public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                cut_at_spaces=True)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents", ["doc_id", "text"]), 16, ["doc_id"])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_conversations(conversation_repair.damage(read_table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_minhash": op4_minhash,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_pii": op7_pii,
    "op8_classifier": op8_classifier,
    "op9_bpe": op9_bpe,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL = {
    "op1_line_dedup": sql.LINE_DEDUP,
    "op2_warc": sql.WARC,
    "op10_exact_dedup": sql.EXACT_DEDUP,
    "op11_prefix_trie": sql.PREFIX_TRIE,
    "op13_conversation_repair": sql.CONVERSATION_REPAIR,
}
