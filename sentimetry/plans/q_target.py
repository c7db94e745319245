"""Registered queries: target definition and design matrix (O19, O101–O104)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import target as TG
from ..sources import fixtures as fx
from . import sql as Q
from .common import corpus, r6, s6
from .q_measures import BASE, BASE_SQL, CLUSTERS, NAMES, _base_once, _cluster_globals, _cluster_sql, _filled, _fill_sql
from .registry import register

MV_SQL = "mv AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) AS volume " \
         "FROM orders GROUP BY 1)"


def _mv(spark, sf):
    return TG.monthly_volume(fx.market(spark, sf))


def _dates(spark, sf):
    """Dates of the base measures, from the corpus' dates alone."""
    return M.measure_dates(corpus(spark, sf), BASE)


def _aligned(spark, sf):
    return TG.align_target(_mv(spark, sf), _dates(spark, sf))


ALIGNED_SQL = BASE_SQL + f""", {MV_SQL},
aligned AS (SELECT date, volume FROM mv WHERE date IN (SELECT date FROM rolled)),
topk AS (SELECT date FROM aligned ORDER BY abs(volume) DESC, date LIMIT 20),
target AS (SELECT a.date, a.volume, CASE WHEN t.date IS NULL THEN 0 ELSE 1 END AS label
  FROM aligned a LEFT JOIN topk t ON t.date = a.date)
"""


def target_monthly(spark, sf):
    return TG.top_abs_events(_aligned(spark, sf), 20)


@register("monthly_volume", Q.with_(MV_SQL) + f"SELECT date, {s6('volume')} AS volume FROM mv")
def monthly_volume(spark, sf):
    """O101: monthly sum of the market volume."""
    return _mv(spark, sf).select("date", r6("volume").alias("volume"))


@register("align_target", ALIGNED_SQL + f"SELECT date, {s6('volume')} AS volume FROM aligned")
def align_target(spark, sf):
    """O102: target periods that also have measures."""
    return _aligned(spark, sf).select("date", r6("volume").alias("volume"))


@register("align_check", ALIGNED_SQL + """SELECT (SELECT count(*) FROM aligned)
  - (SELECT count(DISTINCT date) FROM rolled WHERE date IN (SELECT date FROM mv)) AS gap""")
def align_check(spark, sf):
    """O102 assertion: aligned target and measure periods agree (gap 0)."""
    return TG.alignment_gap(_mv(spark, sf), _dates(spark, sf))


@register("top_abs_events", ALIGNED_SQL + f"SELECT date, {s6('volume')} AS volume, label FROM target")
def top_abs_events(spark, sf):
    """O103: the 20 months with the largest |volume| are events."""
    return target_monthly(spark, sf).select("date", r6("volume").alias("volume"), "label")


@register("timeline_target", _fill_sql("day", "latest").rsplit("\nSELECT", 1)[0] + f""", {Q.TIMELINE}
SELECT DISTINCT f.date, CASE WHEN t.date IS NULL THEN 0 ELSE 1 END AS label
FROM filled f LEFT JOIN timeline t ON t.date = f.date""")
def timeline_target(spark, sf):
    """O104: label 1 on event dates of the daily measure dates (all kept)."""
    return TG.timeline_target(_filled(spark, sf, "day", "latest"), fx.timeline(spark))


def _q(n: str) -> str:
    return '"' + n + '"'


@register("design_matrix", _cluster_sql() + f""", {MV_SQL},
aligned AS (SELECT date, volume FROM mv WHERE date IN (SELECT date FROM rolled)),
topk AS (SELECT date FROM aligned ORDER BY abs(volume) DESC, date LIMIT 20),
target AS (SELECT a.date, CASE WHEN t.date IS NULL THEN 0 ELSE 1 END AS label FROM aligned a LEFT JOIN topk t
  ON t.date = a.date),
gw AS (SELECT date, {', '.join(f"max(CASE WHEN cluster = {Q.q(c)} THEN global END) AS glob_{c}" for c in CLUSTERS)}
  FROM globs GROUP BY date),
mw AS (SELECT date, {', '.join(f"max(CASE WHEN lexicon || '--' || feature || '--' || time = {Q.q(n)} THEN value END)"
                               f" AS {_q(n)}" for n in NAMES)} FROM rolled GROUP BY date)
SELECT t.date, t.label, {', '.join(f"{s6('g.glob_' + c)} AS glob_{c}" for c in CLUSTERS)},
  {', '.join(f"{s6('m.' + _q(n))} AS {_q(n)}" for n in NAMES)}
FROM target t JOIN gw g ON g.date = t.date JOIN mw m ON m.date = t.date""")
def design_matrix(spark, sf):
    """Target, cluster indices and all measures joined on date."""
    return _design(spark, sf)


def _design(spark, sf, round_=True):
    base = _base_once(spark, sf)
    dm = TG.design_matrix(target_monthly(spark, sf), _cluster_globals(spark, sf, base), base, NAMES,
                          list(CLUSTERS))
    if not round_:
        return dm
    return dm.select("date", "label", *[r6(F.col(f"`{c}`")).alias(c) for c in dm.columns[2:]])

