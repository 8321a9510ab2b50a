"""The registered queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, lm_score, mixing, near_dedup, pii, quality, substring_dedup, toxicity, url_filter
from .common import table


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.repeated_units(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), far=True).drop("digest")


def op7_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_url_filters(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
}
ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op3_benchmark_decontamination": decontaminate.ORACLE,
    "op7_embedding_near_dedup": embedding_dedup.ORACLE,
    "op8_url_filters": url_filter.ORACLE,
    "op9_mixing": mixing.ORACLE,
}
