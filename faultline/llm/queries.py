"""One query for each llm operator, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.ann import ORACLE as NEAREST_ORACLE
from faultline.llm.ann import nearest
from faultline.llm.decontaminate import leaks
from faultline.llm.hard_negatives import ORACLE as NEGATIVES_ORACLE
from faultline.llm.hard_negatives import hard_negatives
from faultline.llm.licenses import licenses
from faultline.llm.lm import lm_scores
from faultline.llm.mixing import soft_mixture
from faultline.llm.near_dup import near_duplicates
from faultline.llm.near_dup import oracle as classes_oracle
from faultline.llm.prefix_trie import ORACLE as TRIE_ORACLE
from faultline.llm.prefix_trie import prefix_trie
from faultline.llm.quality import quality_scores
from faultline.llm.secrets import oracle as secrets_oracle
from faultline.llm.secrets import secrets
from faultline.llm.shared import table
from faultline.llm.simhash import simhash_components
from faultline.llm.token_counts import masked_token_counts
from faultline.llm.token_files import token_files

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


#: Shares of the languages in the mixture, which are the domains here.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled rows and their domain."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixture(table(spark, sf_dir, "documents"), labelled_domains(spark, sf_dir), TARGETS)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op3_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_token_counts(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_licenses, op3_leaks, op4_secrets, op5_near_duplicates, op6_lm_scores, op7_nearest, op8_token_counts, op9_token_files, op10_quality, op11_prefix_trie, op12_simhash, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_secrets": secrets_oracle(), "op5_near_duplicates": classes_oracle(), "op7_nearest": NEAREST_ORACLE, "op11_prefix_trie": TRIE_ORACLE, "op13_hard_negatives": NEGATIVES_ORACLE}
