"""Corpus projections, filters and splits.

Filters stay on base columns (``date``, ``text``, the feature map) so Catalyst
can push date predicates into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast


def exclude_matching(corpus: DataFrame, pattern: str, ids: list[int] | DataFrame | None = None) -> DataFrame:
    """Drop documents whose text matches ``pattern`` (and, optionally, an
    id list).  Unlike ``x[-grep(p), ]`` nothing is lost when nothing matches."""
    out = corpus.where(~F.coalesce(F.col("text").rlike(pattern), F.lit(False)))
    if ids is None:
        return out
    if isinstance(ids, DataFrame):
        return out.join(bounded_broadcast(ids.select(F.col(ids.columns[0]).alias("id"))), "id", "left_anti")
    return out.where(~F.col("id").isin(list(ids)))


def filter_date_after(corpus: DataFrame, date: str) -> DataFrame:
    """Documents strictly after ``date``."""
    return corpus.where(F.col("date") > F.lit(date).cast("date"))


def filter_feature_ne(corpus: DataFrame, feature: str, value: float) -> DataFrame:
    """Documents whose feature differs from ``value``."""
    return corpus.where(F.col("features")[feature] != F.lit(value))


def docs_on_event_dates(corpus: DataFrame, timeline: DataFrame) -> DataFrame:
    """Documents dated on an event (left semi join on date)."""
    return corpus.join(bounded_broadcast(timeline.select("date").distinct()), "date", "left_semi")


def docs_in_event_month(corpus: DataFrame, timeline: DataFrame) -> DataFrame:
    """``(event, month, id, date, text)`` for the documents of each event's
    month; every event at once through one equi-join on the month key."""
    ev = timeline.select("event", F.date_format("date", "yyyy-MM").alias("month"))
    c = corpus.withColumn("month", F.date_format("date", "yyyy-MM"))
    return c.join(bounded_broadcast(ev), "month").select("event", "month", "id", "date", "text")


def sample_split(corpus: DataFrame, split_date: str) -> DataFrame:
    """``sample`` = dev when date ≤ split date, else val."""
    d = F.lit(split_date).cast("date")
    return corpus.withColumn("sample", F.when(F.col("date") <= d, F.lit("dev")).otherwise(F.lit("val")))
