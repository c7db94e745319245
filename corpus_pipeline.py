"""Training-corpus pipeline: five stages, each one operator of ``sentimetry.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet to the shared folder and read again as the next stage's
documents, so a lost executor never costs an earlier stage.  Every stage works
on all that the one before kept.  All but the last return the columns of
``documents`` with all extra ones, whatever they are called; the last adds
``copies`` (``mix_copies`` beside a column of that name) and leaves out what the mix takes no
copy of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentimetry.llm.decontamination import decontaminate
from sentimetry.llm.line_dedup import without_boilerplate
from sentimetry.llm.mixing import mixed_documents
from sentimetry.llm.order_minhash import one_of_each
from sentimetry.llm.quality_classifier import good_documents
from sentimetry.llm.store import lake, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return good_documents(docs, lake(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return without_boilerplate(docs).select("page.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of least id."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark items."""
    return decontaminate(docs, lake(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their copies."""
    return mixed_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]

#: Training a classifier and aligning near copies can't be said in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lake(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
