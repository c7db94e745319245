"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import lake


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest, repeated_spans

    return digest(repeated_spans(lake(spark, sf_dir, "documents"), width=200))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import lm_scores

    training = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    return lm_scores(lake(spark, sf_dir, "documents"), training)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(lake(spark, sf_dir, "documents"), lake(spark, sf_dir, "labels"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_duplicates

    classes, _ = near_duplicates(lake(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("representative"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_boilerplate

    return drop_boilerplate(lake(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination, digest

    return digest(contamination(lake(spark, sf_dir, "documents"), lake(spark, sf_dir, "benchmark")))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import main_text

    return main_text(lake(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(lake(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import read_vocabulary, token_counts

    return token_counts(lake(spark, sf_dir, "documents"), read_vocabulary())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(lake(spark, sf_dir, "documents")).drop("key", "source")


def op11_ns_bounds_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .centroids import digest

    return digest(lake(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import token_alignment

    return token_alignment(lake(spark, sf_dir, "documents"))


def op13_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_join

    rows, _ = jaccard_join(lake(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": corpus_pipeline.run} | {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .centroids import clustering_sql
    from .decontamination import decontamination_sql
    from .line_dedup import line_dedup_sql

    return {"op5_line_dedup": line_dedup_sql(), "op6_decontamination": decontamination_sql(), "op11_ns_bounds_clusters": clustering_sql()}
