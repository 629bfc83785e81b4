"""The thin queries ``opN_<name>`` with production parameters, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regatta.llm import filter_audit, hard_negatives, host_rules
from regatta.llm.html_extract import extract
from regatta.llm.license_scan import license_scan
from regatta.llm.mixing import mixed
from regatta.llm.packing import packed
from regatta.llm.quality_model import quality
from regatta.llm.simhash import simhash_groups
from regatta.llm.suffix_dedup import suffix_dedup
from regatta.llm.token_counts import token_counts
from regatta.llm.toxicity import toxicity_scores
from regatta.llm.vector_dedup import vector_links


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), limit=3.0, seed=42)


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup(_table(spark, sf_dir, "documents"), length=100, with_text=False)
    return done.select("doc_id", "dedup.n_bytes", "dedup.n_removed", "dedup.n_spans", "dedup.kept_sha256")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.host_rules(_table(spark, sf_dir, "documents")).drop("host_rate")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), distance=2).select("doc_id", "fingerprint", "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("finds")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    relabelled = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.hard_negatives(relabelled, anchor=F.col("vec_id") % 100 == 0, positives=5, negatives=10, lower=30, upper=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_source_mixing,
        op3_vector_dedup,
        op4_suffix_dedup,
        op5_best_fit_packing,
        op6_host_rules,
        op7_simhash,
        op8_token_counts,
        op9_html_extraction,
        op10_quality,
        op11_filter_audit,
        op12_license_scan,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {"op6_host_rules": host_rules.SQL, "op11_filter_audit": filter_audit.SQL, "op13_hard_negatives": hard_negatives.SQL}
