"""Prediction with given coefficients, evaluation and attribution (O118–O125).

Measures stay long; the coefficients are a small ``(measure, beta)`` table
(one row per regressor) joined by measure name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, inherit_bound, mark_bounded

DIMS = ("lexicon", "feature", "time")


def _named(measures: DataFrame) -> DataFrame:
    return measures.withColumn("measure", F.concat_ws("--", *DIMS))


def _weighted(measures: DataFrame, coefs: DataFrame, how: str = "inner") -> DataFrame:
    side = inherit_bound(coefs.select("measure", "beta"), coefs)
    return _named(measures).join(bounded_broadcast(side), "measure", how)


def predict_link(measures: DataFrame, coefs: DataFrame, intercept: float) -> DataFrame:
    """O119: linear predictor b0 + Σ beta·value per date.  A left join keeps
    every date (one without coefficient measures keeps b0) in a single pass
    over the measures."""
    return _weighted(measures, coefs, "left").groupBy("date").agg(
        (F.lit(intercept) + F.coalesce(F.sum(F.col("beta") * F.col("value")), F.lit(0.0))).alias("link"))


def predict_class(link: DataFrame) -> DataFrame:
    """O118: class 1 when the probability is at least 0.5 (link ≥ 0)."""
    return link.select("date", (F.col("link") >= 0).cast("int").alias("pred"))


def confusion_scores(pred: DataFrame, target: DataFrame) -> DataFrame:
    """O120: TP, TN, FP, FN, TPR, TNR, accuracy of predictions vs labels."""
    j = pred.join(target.select("date", "label"), "date")
    p, y = F.col("pred"), F.col("label")
    out = j.agg(F.count_if((p == 1) & (y == 1)).alias("TP"), F.count_if((p == 0) & (y == 0)).alias("TN"),
                F.count_if((p == 1) & (y == 0)).alias("FP"), F.count_if((p == 0) & (y == 1)).alias("FN"))
    return out.select("TP", "TN", "FP", "FN",
                      F.try_divide(F.col("TP"), (F.col("TP") + F.col("FN")).cast("double")).alias("TPR"),
                      F.try_divide(F.col("TN"), (F.col("TN") + F.col("FP")).cast("double")).alias("TNR"),
                      F.try_divide(F.col("TP") + F.col("TN"), (F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN"))
                                   .cast("double")).alias("accuracy"))


def binary_plot_table(pred: DataFrame, target: DataFrame, only_events: bool = False) -> DataFrame:
    """O121: (date, true, predicted) melted to ``(date, variable, value)``."""
    j = pred.join(target.select("date", F.col("label").alias("true")), "date").select(
        "date", "true", F.col("pred").alias("predicted"))
    if only_events:
        j = j.where(F.col("true") == 1)
    return j.unpivot("date", ["true", "predicted"], "variable", "value")


def attribution(measures: DataFrame, coefs: DataFrame, dim: str = "lexicon", members: list[str] | None = None):
    """O122: per date and member of one dimension, Σ beta·value over the
    measures of that member; long ``(date, member, attrib)`` or, with
    ``members``, one column per member."""
    if dim not in DIMS:
        raise ValueError(f"dim is one of {DIMS}")
    if members is None:
        return _weighted(measures, coefs).groupBy("date", F.col(dim).alias("member")).agg(
            F.sum(F.col("beta") * F.col("value")).alias("attrib"))
    # one pass: the left join keeps every date, the pivot has its value list
    wide = _weighted(measures, coefs, "left").groupBy("date").pivot(dim, members).agg(
        F.sum(F.col("beta") * F.col("value")))
    return wide.select("date", *[F.coalesce(F.col(m), F.lit(0.0)).alias(m) for m in members])


def attribution_all_dims(measures: DataFrame, coefs: DataFrame) -> DataFrame:
    """O123: attributions by lexicon, feature and time in one grouping-sets
    aggregate ``(date, dim, member, attrib)``."""
    w = _weighted(measures, coefs).withColumn("bv", F.col("beta") * F.col("value"))
    g = w.groupingSets([["date", "lexicon"], ["date", "feature"], ["date", "time"]],
                       "date", "lexicon", "feature", "time").agg(
        F.sum("bv").alias("attrib"), F.grouping("lexicon").alias("_gl"), F.grouping("feature").alias("_gf"))
    dim = F.when(F.col("_gl") == 0, F.lit("lexicon")).when(F.col("_gf") == 0, F.lit("feature")).otherwise(F.lit("time"))
    return g.select("date", dim.alias("dim"), F.coalesce("lexicon", "feature", "time").alias("member"), "attrib")


def attribution_by_lag(series: DataFrame, schemes: dict[str, list[float]], coefs: DataFrame) -> DataFrame:
    """O123, lag dimension: what each period back adds to a date's link,
    Σ beta · weight · value over measures ``(date, dim, member, attrib)``;
    ``series``: filled ``(date, lexicon, feature, value)`` before the windows;
    member 0 is the date's own period.  Sums over lags equal the other dimensions'."""
    spark, lag = series.sparkSession, len(next(iter(schemes.values())))
    rows = [(n, lag - 1 - i, float(w)) for n, ws in schemes.items() for i, w in enumerate(ws)]
    weights = mark_bounded(spark.createDataFrame(rows, "time string, back int, w double"), len(rows))
    w = Window.partitionBy("lexicon", "feature").orderBy("date").rowsBetween(-(lag - 1), 0)
    frame = series.select("date", "lexicon", "feature", F.collect_list("value").over(w).alias("v")).where(F.size("v") == lag)
    cells = frame.select("date", "lexicon", "feature", F.posexplode("v").alias("p", "value")).withColumn("back", F.lit(lag - 1) - F.col("p"))
    named = cells.join(bounded_broadcast(weights), "back")
    parts = _weighted(named.select("date", "lexicon", "feature", "time", "back", (F.col("w") * F.col("value")).alias("value")), coefs)
    return parts.groupBy("date", "back").agg(F.sum(F.col("beta") * F.col("value")).alias("attrib")).select(
        "date", F.lit("lag").alias("dim"), F.col("back").cast("string").alias("member"), "attrib")


def attribution_check(link: DataFrame, attrib_long: DataFrame, intercept: float) -> DataFrame:
    """O124: link − intercept − Σ attributions per date (≈ 0)."""
    s = attrib_long.groupBy("date").agg(F.sum("attrib").alias("sa"))
    return link.join(s, "date", "left").select(
        "date", (F.col("link") - F.lit(intercept) - F.coalesce("sa", F.lit(0.0))).alias("residual"))


def attribution_plot_table(attrib_long: DataFrame) -> DataFrame:
    """O125: melted attributions ordered by variable rank, with the number of
    variables (the plot shows a legend up to 12)."""
    names = attrib_long.select("member").distinct()
    # one row per variable: a few names, so the global rank is cheap
    ranked = names.select("member", F.dense_rank().over(Window.orderBy("member")).alias("rank"))
    n_vars = names.select(F.count("*")).scalar()
    return attrib_long.join(ranked, "member").select(
        "date", F.col("member").alias("variable"), F.col("attrib").alias("value"), "rank",
        (F.lit(n_vars) <= 12).alias("legend"))
