"""Registered queries of the operators and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .decontaminate import contaminated_pairs
from .language import identify_languages
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .pii import pii_report
from .quality import quality_rules
from .secrets import scan_secrets
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .token_align import align_tokens
from .toxicity import score_toxicity
from .url_filter import filter_urls, oracle_sql
from .whitening import whiten


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir), n=4, percent=85)


def op2_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), shards=40)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), capacity=2048, per_source=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op5_secret_ownership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


def op7_hyperdimensional_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(documents(spark, sf_dir))


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir))


def op13_host_reputation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("reputation", "bound")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_label_propagation_shards": op2_label_propagation_shards,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_ownership_scan": op5_secret_ownership_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_hyperdimensional_language_id": op7_hyperdimensional_language_id,
    "op8_weak_supervision_pii": op8_weak_supervision_pii,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_deobfuscated_toxicity": op10_deobfuscated_toxicity,
    "op11_jacobi_davidson_whitening": op11_jacobi_davidson_whitening,
    "op12_cross_tokenizer_alignment": op12_cross_tokenizer_alignment,
    "op13_host_reputation_filter": op13_host_reputation_filter,
}
ORACLES: dict[str, str] = {"op13_host_reputation_filter": oracle_sql()}
