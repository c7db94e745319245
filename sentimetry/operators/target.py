"""Target definition and design matrix (O19, O101–O104)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast


def monthly_volume(series: DataFrame, value_col: str = "volume") -> DataFrame:
    """O101: sum of the value per month (first day), ``(date, volume)``."""
    return series.groupBy(F.trunc("date", "month").alias("date")).agg(F.sum(value_col).alias("volume"))


def align_target(target: DataFrame, measures: DataFrame) -> DataFrame:
    """O102: keep the periods present on both sides (semi joins both ways).

    Returns the aligned target; :func:`alignment_gap` gives the count check.
    """
    mdates = measures.select("date").distinct()
    return target.join(mdates, "date", "left_semi")


def alignment_gap(target: DataFrame, measures: DataFrame) -> DataFrame:
    """O102 check: aligned target periods minus aligned measure periods (0)."""
    t = align_target(target, measures).select("date").distinct()
    m = measures.select("date").distinct().join(target.select("date"), "date", "left_semi")
    return t.agg(F.count("*").alias("nt")).select(
        (F.col("nt") - m.select(F.count("*")).scalar()).alias("gap"))


def top_abs_events(target: DataFrame, n: int = 20, value_col: str = "volume") -> DataFrame:
    """O103: the n periods with the largest |value| get label 1, others 0;
    ties go to the earlier date.  A top-k (no unpartitioned window) joined
    back to the series."""
    top = (target.orderBy(F.abs(F.col(value_col)).desc(), "date").limit(n)
           .select("date", F.lit(1).alias("_hit")))
    return target.join(top, "date", "left").select(
        "date", F.col(value_col), F.coalesce("_hit", F.lit(0)).alias("label"))


def timeline_target(dates: DataFrame, timeline: DataFrame | None) -> DataFrame:
    """O104: label 1 when the date is an event date; all dates kept."""
    if timeline is None:
        raise ValueError("Provide a timeline table with important events")
    ev = timeline.select("date").distinct().withColumn("_hit", F.lit(1))
    return dates.select("date").distinct().join(bounded_broadcast(ev), "date", "left").select(
        "date", F.coalesce("_hit", F.lit(0)).alias("label"))


def design_matrix(target: DataFrame, globals_: DataFrame, measures: DataFrame, measure_names: list[str],
                  clusters: list[str]) -> DataFrame:
    """Target + global indices + measures, joined on date (not by
    position) after pivoting with explicit value lists."""
    g = globals_.groupBy("date").pivot("cluster", clusters).agg(F.first("global"))
    g = g.select("date", *[F.col(c).alias(f"glob_{c}") for c in clusters])
    m = (measures.withColumn("measure", F.concat_ws("--", "lexicon", "feature", "time"))
         .groupBy("date").pivot("measure", measure_names).agg(F.first("value")))
    return target.select("date", "label").join(g, "date").join(m, "date")
