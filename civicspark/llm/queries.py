"""Named queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, fingerprints, forest, lexical, licenses, manifest, mixing, neardup, packing, suffixes, toxicity, urls
from .common import read


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op1_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.search(read(spark, sf_dir, "embeddings"), lambda rows: rows.where("vec_id % 100 = 0"))


def op2_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.labelled(read(spark, sf_dir, "documents"), width=4)


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conflict = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", conflict), (-1, 1, "assistant", conflict)], turns.schema)
    return chat.conversation_digests(chat.format_turns(turns.unionByName(extra)))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_digests(read(spark, sf_dir, "documents"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(read(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"))


def op10_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verify(read(spark, sf_dir, "documents"))


def op12_nra_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_mixing_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_prefix_forest": op1_hash_prefix_forest,
    "op2_minhash_inverted_join": op2_minhash_inverted_join,
    "op3_bin_completion": op3_bin_completion,
    "op4_chat_round_trip": op4_chat_round_trip,
    "op5_suffix_array": op5_suffix_array,
    "op6_closed_syncmers": op6_closed_syncmers,
    "op7_toxicity": op7_toxicity,
    "op8_url_filter": op8_url_filter,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_license_classifier": op10_license_classifier,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_nra_lexical_search": op12_nra_lexical_search,
    "op13_mixing_quotas": op13_mixing_quotas,
}

STATEMENTS: dict[str, str] = {
    "op4_chat_round_trip": chat.SQL,
    "op12_nra_lexical_search": lexical.SQL,
}
