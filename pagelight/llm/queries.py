"""The queries of this subpackage, one opN_<name> for each operator, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelight.llm import ann, bpe, decontaminate, license, pii, quality, shards, simhash, substring, toxicity
from pagelight.llm.common import read_table


def op5_decontaminate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read_table(spark, sf_dir, "documents"))


def op7_toxicity_nb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read_table(spark, sf_dir, "documents"))


def op1_ann_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(read_table(spark, sf_dir, "embeddings"))


def op2_shards_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(read_table(spark, sf_dir, "documents"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read_table(spark, sf_dir, "documents"))


def op4_substring_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read_table(spark, sf_dir, "documents"))


def op10_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann_posting_lists": op1_ann_posting_lists,
    "op2_shards_splitters": op2_shards_splitters,
    "op3_simhash_gray": op3_simhash_gray,
    "op4_substring_rabin_karp": op4_substring_rabin_karp,
    "op5_decontaminate_prefix": op5_decontaminate_prefix,
    "op6_pii_bootstrap": op6_pii_bootstrap,
    "op7_toxicity_nb": op7_toxicity_nb,
    "op8_quality_pu": op8_quality_pu,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_license_index": op10_license_index,
}

ORACLE_SQL: dict[str, str] = {
    "op2_shards_splitters": shards.SQL,
    "op4_substring_rabin_karp": substring.SQL,
    "op5_decontaminate_prefix": decontaminate.SQL,
    "op10_license_index": license.sql(),
}
