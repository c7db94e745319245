"""Sentiment measures: time aggregation, gap filling, rolling windows and the
operators on the resulting series (O18, O65–O82, O126, O127).

Measures stay long, ``(date, lexicon, feature, time, value)``; a measure's
name is ``lexicon--feature--time``.  After the per-period aggregate the data
is periods × measures, never documents, so the windows below are cheap; they
are partitioned by measure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import period_bucket, period_from_index, period_index
from ..functions.weights import time_schemes
from .sentiment import HOWS, UNITS, document_sentiment

KEYS = ["lexicon", "feature"]
DIMS = ["lexicon", "feature", "time"]


@dataclass(frozen=True)
class AggOptions:
    """``ctr_agg`` options."""

    how_within: str = "counts"
    how_docs: str = "equal_weight"
    how_time: tuple[str, ...] = ("equal_weight",)
    by: str = "day"
    lag: int = 1
    fill: str = "zero"
    ignore_zeros: bool = True
    alphas_exp: tuple[float, ...] = (0.1, 0.5, 0.9)
    orders_alm: tuple[int, ...] = (1, 2, 3)
    do_inverse_alm: bool = True
    do_normalize_alm: bool = True
    units: tuple[str, ...] = UNITS
    phrase_mode: str = "unit"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.how_within not in HOWS:
            raise ValueError(f"how_within must be one of {HOWS}")
        if self.how_docs not in ("equal_weight", "proportional"):
            raise ValueError("how_docs is equal_weight or proportional")
        if self.by not in ("day", "week", "month", "year"):
            raise ValueError("by is day, week, month or year")
        if self.fill not in ("zero", "latest", "none"):
            raise ValueError("fill is zero, latest or none")
        if self.lag < 1:
            raise ValueError("lag must be at least 1")
        self.schemes()  # validates the weighting options

    def schemes(self) -> dict[str, list[float]]:
        return time_schemes(self.how_time, self.lag, self.alphas_exp, self.orders_alm,
                            self.do_inverse_alm, self.do_normalize_alm)


def measure_name() -> F.Column:
    return F.concat_ws("--", "lexicon", "feature", "time")


def aggregate_documents(doc_sent: DataFrame, by: str = "day", how_docs: str = "equal_weight",
                        ignore_zeros: bool = True, extra_keys: list[str] | None = None) -> DataFrame:
    """O65/O66 with O67: per period, lexicon and feature.

    equal_weight: mean of document scores; proportional: weights
    word_count / Σ word_count.  With ``ignore_zeros`` zero scores leave both
    numerator and denominator; nothing left gives 0.
    """
    keys = (extra_keys or []) + KEYS
    d = doc_sent.withColumn("date", period_bucket("date", by))
    nz = (F.col("score") != 0) if ignore_zeros else F.lit(True)
    if how_docs == "equal_weight":
        val = F.try_divide(F.sum(F.when(nz, F.col("score"))), F.count(F.when(nz, 1)).cast("double"))
    elif how_docs == "proportional":
        val = F.try_divide(F.sum(F.col("score") * F.col("word_count")),
                           F.sum(F.when(nz, F.col("word_count"))).cast("double"))
    else:
        raise ValueError("how_docs is equal_weight or proportional")
    return d.groupBy("date", *keys).agg(F.coalesce(val, F.lit(0.0)).alias("value"))


def period_ends(dated: DataFrame, by: str) -> DataFrame:
    """One row (lo, hi): the first and last period of the column ``date``."""
    return dated.agg(F.min(period_index("date", by)).alias("lo"), F.max(period_index("date", by)).alias("hi"))


def fill_periods(series: DataFrame, by: str, fill: str = "zero", keys: list[str] | None = None,
                 ends: DataFrame | None = None) -> DataFrame:
    """Add the missing periods of one grid, from the first to the last
    period of the whole table; ``zero`` puts 0, ``latest`` the last value (none
    before a series' first).

    Each row looks at the next period of its series (``lead`` over a window
    partitioned by the series key) and emits the periods up to it with
    ``sequence``.  The grid's ends are ``ends`` (:func:`period_ends`, of the
    corpus' dates where the series come from one, so that the text pipeline
    behind them runs once), else those of the series, as scalar subqueries: no
    row leaves its series' partition.  Series with further keys (events) have a
    grid for each of these.
    """
    keys = keys or KEYS
    if fill == "none":
        return series
    if fill not in ("zero", "latest"):
        raise ValueError("fill is zero, latest or none")
    # events and the like have their own periods; the grid is per what isn't a measure key
    own = [k for k in keys if k not in KEYS]
    w = Window.partitionBy(*keys).orderBy("_i")
    s = series.withColumn("_i", period_index("date", by))
    if own:
        low, high = F.min("_i").over(Window.partitionBy(*own)), F.max("_i").over(Window.partitionBy(*own))
    else:
        ends = period_ends(series, by) if ends is None else ends
        low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    s = s.withColumn("_n", F.coalesce(F.lead("_i").over(w), high + 1))
    first = F.when(F.lag("_i").over(w).isNull(), low).otherwise(F.col("_i"))
    s = s.withColumn("_from", first if fill == "zero" else F.col("_i"))
    ex = s.select(*keys, "value", "_i", F.explode(F.sequence(F.col("_from"), F.col("_n") - 1)).alias("_j"))
    v = F.col("value") if fill == "latest" else F.when(F.col("_j") == F.col("_i"), F.col("value")).otherwise(0.0)
    return ex.select(period_from_index("_j", by).alias("date"), *keys, v.alias("value"))


def measure_dates(corpus: DataFrame, opts: AggOptions) -> DataFrame:
    """The dates that measures of ``opts`` have: the grid of periods from the
    corpus' first to its last, without the first ``lag − 1``.  It reads the date
    column only, not the text."""
    if opts.fill == "none":
        raise ValueError("without filling the dates are those of the measures themselves")
    ends = period_ends(corpus, opts.by)
    full = ends.where(F.col("hi") - F.col("lo") >= opts.lag - 1)
    return full.select(F.explode(F.sequence(F.col("lo") + (opts.lag - 1), "hi")).alias("_j")).select(
        period_from_index("_j", opts.by).alias("date"))


def roll_series(series: DataFrame, schemes: dict[str, list[float]], keys: list[str] | None = None) -> DataFrame:
    """Weighted moving windows, every scheme in one window pass.

    Per series the last ``lag`` values are gathered with a row frame, and each
    scheme is a dot product with its weight literal.  Periods with fewer than
    ``lag`` values in the frame are dropped (the series starts at the lag-th
    period).  Output ``(date, *keys, time, value)``.
    """
    keys = keys or KEYS
    lags = {len(w) for w in schemes.values()}
    if len(lags) != 1:
        raise ValueError("all schemes must share one lag")
    lag = lags.pop()
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(lag - 1), 0)
    framed = series.select("date", *keys, F.collect_list("value").over(w).alias("_v"))
    framed = framed.where(F.size("_v") == lag)
    per_scheme = F.array(*[
        F.struct(F.lit(name).alias("time"),
                 F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in wts]), lambda a, b: a * b),
                             F.lit(0.0), lambda acc, x: acc + x).alias("value"))
        for name, wts in schemes.items()])
    return framed.select("date", *keys, F.explode(per_scheme).alias("_s")).select(
        "date", *keys, "_s.time", "_s.value")


def aggregate_measures(doc_sent: DataFrame, opts: AggOptions, extra_keys: list[str] | None = None,
                       ends: DataFrame | None = None) -> DataFrame:
    """``perform_agg``: documents → periods → filled grid → rolled measures."""
    keys = (extra_keys or []) + KEYS
    per = aggregate_documents(doc_sent, opts.by, opts.how_docs, opts.ignore_zeros, extra_keys)
    filled = fill_periods(per, opts.by, opts.fill, keys, ends)
    return roll_series(filled, opts.schemes(), keys)


def sentiment_measures(corpus: DataFrame, lexicons: DataFrame, opts: AggOptions, valence: DataFrame | None = None,
                       stopwords: list[str] | None = None) -> DataFrame:
    """O126: corpus + lexicons + options → long measures, one lazy plan."""
    ds = document_sentiment(corpus, lexicons, valence, stopwords, opts.how_within, opts.units, opts.phrase_mode)
    return aggregate_measures(ds, opts, ends=period_ends(corpus, opts.by))


def event_month_corpus(corpus: DataFrame, timeline: DataFrame) -> DataFrame:
    """O16 for all events at once: documents of each event's month, tagged
    with the event (equi-join on the ``yyyy-MM`` key; the timeline is a
    small parameter table)."""
    from ..session import bounded_broadcast
    ev = timeline.select("event", F.date_format("date", "yyyy-MM").alias("_mk"))
    return corpus.withColumn("_mk", F.date_format("date", "yyyy-MM")).join(bounded_broadcast(ev), "_mk").drop("_mk")


def measures_wide(measures: DataFrame, names: list[str]) -> DataFrame:
    """Date × ``lexicon--feature--time`` columns; the value list is given,
    so the pivot needs no extra job to find it."""
    return measures.withColumn("measure", measure_name()).groupBy("date").pivot("measure", names).agg(
        F.first("value"))


def measures_stats(measures: DataFrame) -> DataFrame:
    """Per measure mean, sd, max, min and mean correlation with the other
    measures, each pair over the dates that both have; a pair whose correlation
    isn't defined (a constant, under two common dates) doesn't count.

    No pair is joined: a date is one row with a vector over the measures, less
    their means, and a task adds up outer products; measures × measures sums
    leave it.
    """
    m = measures.withColumn("measure", measure_name()).select("date", "measure", F.col("value").cast("double").alias("value"))
    basic = m.groupBy("measure").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.max("value").alias("max"), F.min("value").alias("min"))
    names = sorted(r[0] for r in m.select("measure").distinct().collect())
    place = F.array_position(F.lit(names) if names else F.array().cast("array<string>"), F.col("measure")) - 1
    rows = m.where("value is not null").join(basic.select("measure", "mean"), "measure").groupBy("date").agg(
        F.collect_list(F.struct(place.cast("int").alias("at"), (F.col("value") - F.col("mean")).alias("x"))).alias("cells"))
    size = len(names)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((4, size, size))
        for batch in batches:
            x, have = np.zeros((2, batch.num_rows, size))
            cells = batch.column("cells")
            row = np.repeat(np.arange(batch.num_rows), cells.value_lengths().to_numpy())
            at = cells.flatten().field("at").to_numpy()
            x[row, at], have[row, at] = cells.flatten().field("x").to_numpy(), 1
            out += [have.T @ have, x.T @ have, (x * x).T @ have, x.T @ x]
        yield pa.record_batch([pa.array([out.ravel()], pa.list_(pa.float64()))], names=["sums"])

    n, sx, sxx, sxy = np.zeros((4, size, size))
    if size:
        cells = rows.select("cells").mapInArrow(products, "sums array<double>").select(F.posexplode("sums").alias("at", "v"))
        total = np.zeros(4 * size * size)
        for r in cells.groupBy("at").agg(F.sum("v").alias("v")).collect():  # 4 x measures x measures numbers
            total[r["at"]] = r["v"]
        n, sx, sxx, sxy = total.reshape(4, size, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = np.maximum(sxx - sx * sx / n, 0)
        spread[spread <= 1e-20 * np.maximum(np.diag(sxx)[:, None], 1e-300)] = 0
        r = (sxy - sx * sx.T / n) / np.sqrt(spread * spread.T)
    np.fill_diagonal(r, np.nan)
    r[~np.isfinite(r)] = np.nan
    mean_r = [(name, float(np.nanmean(row)) if np.isfinite(row).any() else None) for name, row in zip(names, r)]
    return basic.join(measures.sparkSession.createDataFrame(mean_r, "measure string, meanCorr double"), "measure", "left")


def select_measures(measures: DataFrame, to_select: list[str], do_combine: bool = True) -> DataFrame:
    """Keep measures whose components contain any of the tokens
    (``do_combine=True``) or all of them (``False``: each token must name one of
    the three components)."""
    toks = list(to_select)
    in_any = lambda t: (F.col("lexicon") == t) | (F.col("feature") == t) | (F.col("time") == t)
    if do_combine:
        cond = F.lit(False)
        for t in toks:
            cond = cond | in_any(t)
    else:
        cond = F.lit(True)
        for t in toks:
            cond = cond & in_any(t)
    return measures.where(cond)


def select_measure_dates(measures: DataFrame, dates: DataFrame) -> DataFrame:
    """Keep measures at the given dates (left semi)."""
    return measures.join(dates.select(F.col(dates.columns[0]).cast("date").alias("date")).distinct(), "date",
                         "left_semi")


def select_measures_by_word(measures: DataFrame, word: str) -> DataFrame:
    """Measures whose name contains ``word`` between word boundaries
    (names are ASCII, so ``\\b`` means the same in every engine)."""
    return measures.where(measure_name().rlike(r"\b" + word + r"\b"))


def merge_measures(measures: DataFrame, lexicons: dict[str, list[str]] | None = None,
                   features: dict[str, list[str]] | None = None, time: dict[str, list[str]] | None = None) -> DataFrame:
    """Average groups of lexicons / features / time schemes into new
    members; the rest is unchanged."""
    out = measures
    for dim, groups in (("lexicon", lexicons), ("feature", features), ("time", time)):
        if not groups:
            continue
        expr = F.col(dim)
        for new, olds in groups.items():
            expr = F.when(F.col(dim).isin(list(olds)), F.lit(new)).otherwise(expr) if expr is not None else expr
        out = out.withColumn(dim, expr)
    return out.groupBy("date", *DIMS).agg(F.avg("value").alias("value"))


def _weight_col(dim: str, weights: dict[str, float] | None) -> F.Column:
    if not weights:
        return F.lit(1.0)
    e = F.lit(None).cast("double")
    for k, v in weights.items():
        e = F.when(F.col(dim) == k, F.lit(float(v))).otherwise(e)
    return e


def global_index(measures: DataFrame, lexicons: dict[str, float] | None = None,
                 features: dict[str, float] | None = None, time: dict[str, float] | None = None) -> DataFrame:
    """One series, Σ v·w / Σ w per date with w = w_lex·w_feat·w_time
    (equal weights by default; measures without a weight are left out)."""
    w = _weight_col("lexicon", lexicons) * _weight_col("feature", features) * _weight_col("time", time)
    m = measures.withColumn("_w", w).where(F.col("_w").isNotNull())
    return m.groupBy("date").agg(
        F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("_w")), F.sum("_w")), F.lit(0.0)).alias("global"))


def cluster_globals(measures: DataFrame, clusters: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """O76 + O79 for several clusters in one pass: a cluster is a set of
    lexicons crossed with a set of features; its index is the equal-weight
    mean of its measures per date.  Membership is a small parameter table
    (broadcast); every cluster comes out of one aggregate, so the measures
    behind it are computed once.  Output ``(cluster, date, global)``."""
    from ..session import bounded_broadcast, mark_bounded
    rows = [(c, lx, f) for c, (lxs, fs) in clusters.items() for lx in lxs for f in fs]
    spark = measures.sparkSession
    member = mark_bounded(spark.createDataFrame(rows, "cluster string, lexicon string, feature string"), len(rows))
    return measures.join(bounded_broadcast(member), ["lexicon", "feature"]).groupBy("cluster", "date").agg(
        F.avg("value").alias("global"))


def spread_index(globals_: DataFrame) -> DataFrame:
    """Pairwise differences of cluster indices ``(cluster, date, global)``
    by date, for cluster pairs c1 < c2."""
    a = globals_.select(F.col("cluster").alias("c1"), "date", F.col("global").alias("g1"))
    b = globals_.select(F.col("cluster").alias("c2"), "date", F.col("global").alias("g2"))
    return a.join(b, "date").where(F.col("c1") < F.col("c2")).select(
        "c1", "c2", "date", (F.col("g1") - F.col("g2")).alias("spread"))


def scale_measures(measures: DataFrame) -> DataFrame:
    """Z-score per measure; a zero-variance measure gives NULL."""
    w = Window.partitionBy(*DIMS)
    return measures.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(w),
                                                     F.stddev_samp("value").over(w)))


def group_series(measures: DataFrame, dim: str) -> DataFrame:
    """Mean series per member of one dimension."""
    return measures.groupBy("date", dim).agg(F.avg("value").alias("value"))
