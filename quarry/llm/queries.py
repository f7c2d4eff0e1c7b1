"""The subpackage's registered queries, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, langid, lines, minhash, packing, quality, rules, shards, sql, urls
from quarry.session import table


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary())


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_multi_index_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.assess(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.page_trials(pages, table(spark, sf_dir, "labels")))


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_bpe_trie": op2_bpe_trie,
        "op3_multi_index_minhash": op3_multi_index_minhash,
        "op4_fuzzy_lines": op4_fuzzy_lines,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_divergence_rules": op6_divergence_rules,
        "op7_url_reputation": op7_url_reputation,
        "op8_vector_sharding": op8_vector_sharding,
        "op9_bin_completion": op9_bin_completion,
        "op10_pruned_graph": op10_pruned_graph,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
