"""Registered queries: sentiment measures (O18, O65–O82, O126, O127)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import measures as M
from ..operators import sentiment as S
from ..sources import fixtures as fx
from . import sql as Q
from .common import LEX_NAMES, corpus, lexicons, r6, s6
from .registry import register

PRE = [Q.CORPUS, Q.FEATS, Q.TOKS, Q.LEXICON, Q.VALENCE, Q.LEX_SETUP]

# Flagship options: proportional scores, monthly equal-weight document
# aggregation, zero fill, 3-month equal and linear windows.
FLAG = M.AggOptions(how_within="proportional", how_docs="equal_weight", how_time=("equal_weight", "linear"),
                    by="month", lag=3, fill="zero", ignore_zeros=True)


def _doc_sent(spark, sf, how="proportional"):
    return S.document_sentiment(corpus(spark, sf), lexicons(spark), fx.valence(spark), fx.STOPWORDS, how)


def _pre():
    return Q.with_(*PRE)[:-1] + ",\n"


def _measures_sql(o: M.AggOptions) -> str:
    return Q.measures_sql(o.how_within, o.how_docs, o.by, o.lag, o.fill, o.ignore_zeros, o.schemes())


def _m_out(df):
    return df.select("date", "lexicon", "feature", "time", r6("value").alias("value"))


M_SEL = f"SELECT date, lexicon, feature, time, {s6('value')} AS value FROM rolled"


def flagship(spark, sf):
    return _m_out(M.sentiment_measures(corpus(spark, sf), lexicons(spark), FLAG, fx.valence(spark), fx.STOPWORDS))


register("sentiment_measures", _measures_sql(FLAG) + M_SEL)(flagship)


def _per_period_sql(by, how_docs, ignore_zeros, how="proportional"):
    return _pre() + Q.doc_sentiment_sql(how) + ",\n" + Q.agg_docs_sql(by, how_docs, ignore_zeros) + \
        f"\nSELECT date, lexicon, feature, {s6('value')} AS value FROM per_period"


def _per_out(df):
    return df.select("date", "lexicon", "feature", r6("value").alias("value"))


@register("agg_docs_equal", _per_period_sql("month", "equal_weight", True))
def agg_docs_equal(spark, sf):
    """Mean of non-zero document scores per month, lexicon and feature."""
    return _per_out(M.aggregate_documents(_doc_sent(spark, sf), "month", "equal_weight", True))


@register("agg_docs_equal_zeros", _per_period_sql("month", "equal_weight", False))
def agg_docs_equal_zeros(spark, sf):
    """O65 with zeros kept."""
    return _per_out(M.aggregate_documents(_doc_sent(spark, sf), "month", "equal_weight", False))


@register("agg_docs_proportional", _per_period_sql("month", "proportional", True, "tf-idf"))
def agg_docs_proportional(spark, sf):
    """Word-count weighted mean of tf-idf document scores per month."""
    return _per_out(M.aggregate_documents(_doc_sent(spark, sf, "tf-idf"), "month", "proportional", True))


@register("period_bucket", _per_period_sql("year", "equal_weight", False, "counts"))
def period_bucket(spark, sf):
    """Yearly periods (first day of the year)."""
    return _per_out(M.aggregate_documents(_doc_sent(spark, sf, "counts"), "year", "equal_weight", False))


def _fill_sql(by, fill):
    return _pre() + Q.doc_sentiment_sql("proportional") + ",\n" + Q.agg_docs_sql(by, "equal_weight", True) + \
        ",\n" + Q.fill_sql(by, fill) + f"\nSELECT date, lexicon, feature, {s6('value')} AS value FROM filled"


def _filled(spark, sf, by, fill):
    per = M.aggregate_documents(_doc_sent(spark, sf), by, "equal_weight", True)
    return _per_out(M.fill_periods(per, by, fill, ends=M.period_ends(corpus(spark, sf), by)))


@register("fill_zero", _fill_sql("week", "zero"))
def fill_zero(spark, sf):
    """Weekly series, missing weeks set to 0."""
    return _filled(spark, sf, "week", "zero")


@register("fill_latest", _fill_sql("day", "latest"))
def fill_latest(spark, sf):
    """Daily series, missing days carry the last value."""
    return _filled(spark, sf, "day", "latest")


def _roll_opts(how_time, lag, by="month", fill="zero", **kw):
    return M.AggOptions(how_within="proportional", how_docs="equal_weight", how_time=how_time, by=by, lag=lag,
                        fill=fill, ignore_zeros=True, **kw)


def _rolled(spark, sf, o):
    return _m_out(M.sentiment_measures(corpus(spark, sf), lexicons(spark), o, fx.valence(spark), fx.STOPWORDS))


ROLL = {
    "roll_equal": _roll_opts(("equal_weight",), 12),
    "roll_linear": _roll_opts(("linear",), 12),
    "roll_exponential": _roll_opts(("exponential",), 12, alphas_exp=(0.2, 0.5)),
    "roll_almon": _roll_opts(("almon",), 100, by="day", fill="latest", orders_alm=(1, 2, 3), do_inverse_alm=True),
}
for _k, _o in ROLL.items():
    register(_k, _measures_sql(_o) + M_SEL)(lambda spark, sf, _o=_o: _rolled(spark, sf, _o))


# --- operators on measures -------------------------------------------------
BASE = _roll_opts(("equal_weight", "linear"), 3)


def _base(spark, sf):
    return M.sentiment_measures(corpus(spark, sf), lexicons(spark), BASE, fx.valence(spark), fx.STOPWORDS)


def _base_once(spark, sf):
    """The base measures written once to the checkpoint folder, for queries
    that read them in several branches (periods × measures rows: small at any
    corpus size), so the text pipeline behind them runs once."""
    from ..session import materialize
    return materialize(_base(spark, sf))


BASE_SQL = _measures_sql(BASE)
NAMES = [f"{lx}--{f}--{t}" for lx in LEX_NAMES for f in fx.FEATURE_NAMES for t in BASE.schemes()]


def _wide_sql():
    cols = ", ".join(f"{s6(f'max(CASE WHEN lexicon || {Q.q(chr(45) * 2)} || feature || {Q.q(chr(45) * 2)} || time = {Q.q(n)} THEN value END)')} AS \"{n}\""
                     for n in NAMES)
    return BASE_SQL + f"SELECT date, {cols} FROM rolled GROUP BY date"


@register("measures_wide", _wide_sql())
def measures_wide(spark, sf):
    """One column per measure (pivot with the known name list)."""
    w = M.measures_wide(_base(spark, sf), NAMES)
    return w.select("date", *[r6(F.col(f"`{n}`")).alias(n) for n in NAMES])


@register("measures_long_count", BASE_SQL + "SELECT lexicon, feature, time, count(*) AS n FROM rolled GROUP BY 1,2,3")
def measures_long_count(spark, sf):
    """Property behind O74: every measure has the same dates."""
    return _base(spark, sf).groupBy("lexicon", "feature", "time").agg(F.count("*").alias("n"))


@register("measures_stats", BASE_SQL + f""",
mm AS (SELECT date, lexicon || '--' || feature || '--' || time AS measure, value FROM rolled),
basic AS (SELECT measure, avg(value) AS mean, stddev_samp(value) AS sd, max(value) AS max, min(value) AS min
  FROM mm GROUP BY 1),
pairs AS (SELECT a.measure AS m1, corr(a.value, b.value) AS r FROM mm a JOIN mm b
  ON a.date = b.date AND a.measure <> b.measure GROUP BY a.measure, b.measure),
mr AS (SELECT m1 AS measure, avg(r) AS meanCorr FROM pairs GROUP BY 1)
SELECT b.measure, {s6('mean')} AS mean, {s6('sd')} AS sd, {s6('max')} AS max, {s6('min')} AS min,
  {s6('meanCorr')} AS meanCorr FROM basic b LEFT JOIN mr USING (measure)""".replace(BASE_SQL, "", 0))
def measures_stats(spark, sf):
    """Mean, sd, max, min, mean correlation with the others."""
    st = M.measures_stats(_base(spark, sf))
    return st.select("measure", *[r6(c).alias(c) for c in ("mean", "sd", "max", "min", "meanCorr")])


def _sel_sql(where):
    return BASE_SQL + f"SELECT date, lexicon, feature, time, {s6('value')} AS value FROM rolled WHERE {where}"


@register("select_measures", _sel_sql("lexicon IN ('LEXA', 'MINE') OR feature IN ('LEXA', 'MINE') "
                                      "OR time IN ('LEXA', 'MINE')"))
def select_measures(spark, sf):
    """O76, any of the components."""
    return _m_out(M.select_measures(_base(spark, sf), ["LEXA", "MINE"], True))


@register("select_measures_all", _sel_sql("lexicon = 'LEXB' AND feature = 'press'"))
def select_measures_all(spark, sf):
    """O76, all components (do.combine = FALSE)."""
    return _m_out(M.select_measures(_base(spark, sf), ["LEXB", "press"], False))


@register("select_columns_by_word", _sel_sql("regexp_matches(lexicon || '--' || feature || '--' || time, "
                                               "'\\bnews\\b')"))
def select_columns_by_word(spark, sf):
    """Measure names containing a word between word boundaries."""
    return _m_out(M.select_measures_by_word(_base(spark, sf), "news"))


@register("select_measure_dates", Q.measures_sql(BASE.how_within, BASE.how_docs, BASE.by, BASE.lag, BASE.fill,
                                                 BASE.ignore_zeros, BASE.schemes())
          + f", {Q.TIMELINE}\nSELECT date, lexicon, feature, time, {s6('value')} AS value FROM rolled "
            "WHERE date IN (SELECT CAST(date_trunc('month', date) AS DATE) FROM timeline)")
def select_measure_dates(spark, sf):
    """Measures at the (month of the) timeline dates."""
    tl = fx.timeline(spark).select(F.trunc("date", "month").alias("date"))
    return _m_out(M.select_measure_dates(_base(spark, sf), tl))


MERGE_F = {"oth_press": ["other", "press"], "news_web": ["news", "web"], "prod_results": ["products", "results"]}


def _merge_case(dim, groups):
    whens = " ".join(f"WHEN {dim} IN ({', '.join(Q.q(x) for x in olds)}) THEN {Q.q(new)}"
                     for new, olds in groups.items())
    return f"CASE {whens} ELSE {dim} END"


MERGED_SQL = BASE_SQL + f""", merged AS (SELECT date, lexicon, {_merge_case('feature', MERGE_F)} AS feature, time,
  avg(value) AS value FROM rolled GROUP BY 1, 2, 3, 4)
"""


@register("merge_measures", MERGED_SQL + f"SELECT date, lexicon, feature, time, {s6('value')} AS value FROM merged")
def merge_measures(spark, sf):
    """Features averaged into clusters."""
    return _m_out(M.merge_measures(_base(spark, sf), features=MERGE_F))


CLUSTERS = {"c1": ["LEXA", "MINE", "oth_press"], "c2": ["LEXA", "MINE", "prod_results"],
            "c3": ["LEXB", "MINE", "news_web"], "c4": ["LEXC", "MINE", "oth_press"]}


def _cluster_globals(spark, sf, base=None):
    # the reference's clusters: two lexicons crossed with one merged feature
    merged = M.merge_measures(base if base is not None else _base(spark, sf), features=MERGE_F)
    return M.cluster_globals(merged, {name: (toks[:2], [toks[2]]) for name, toks in CLUSTERS.items()})


def _cluster_sql():
    parts = " UNION ALL ".join(
        f"SELECT {Q.q(n)} AS cluster, date, sum(value) / count(*) AS global FROM merged "
        f"WHERE feature = {Q.q(t[2])} AND lexicon IN ({Q.q(t[0])}, {Q.q(t[1])}) GROUP BY date"
        for n, t in CLUSTERS.items())
    once = MERGED_SQL.replace("merged AS (", "merged AS MATERIALIZED (")
    return once + f", globs AS MATERIALIZED ({parts})\n"


@register("global_index", BASE_SQL + """, w AS (SELECT date, value,
  CASE lexicon WHEN 'LEXA' THEN 0.4 WHEN 'LEXB' THEN 0.2 WHEN 'LEXC' THEN 0.2 WHEN 'MINE' THEN 0.2 END AS w
  FROM rolled)
SELECT date, """ + s6("sum(value * w) / sum(w)") + " AS global FROM w GROUP BY date")
def global_index(spark, sf):
    """Lexicon-weighted global index (weights .4/.2/.2/.2)."""
    g = M.global_index(_base(spark, sf), lexicons={"LEXA": 0.4, "LEXB": 0.2, "LEXC": 0.2, "MINE": 0.2})
    return g.select("date", r6("global").alias("global"))


@register("cluster_globals", _cluster_sql() + f"SELECT cluster, date, {s6('global')} AS global FROM globs")
def cluster_globals(spark, sf):
    """O79 per cluster of O76 selections on merged measures."""
    return _cluster_globals(spark, sf).select("cluster", "date", r6("global").alias("global"))


@register("spread_index", _cluster_sql() + f"""SELECT a.cluster AS c1, b.cluster AS c2, a.date,
  {s6('a.global - b.global')} AS spread FROM globs a JOIN globs b ON a.date = b.date AND a.cluster < b.cluster""")
def spread_index(spark, sf):
    """Pairwise differences of the cluster indices."""
    sp = M.spread_index(_cluster_globals(spark, sf))
    return sp.select("c1", "c2", "date", r6("spread").alias("spread"))


@register("scale_measures", BASE_SQL + f"""SELECT date, lexicon, feature, time,
  {s6("(value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0)")} AS value
  FROM rolled WINDOW w AS (PARTITION BY lexicon, feature, time)""")
def scale_measures(spark, sf):
    """Z-score per measure (NULL for a constant measure)."""
    return _m_out(M.scale_measures(_base(spark, sf)))


@register("group_series", BASE_SQL + f"SELECT date, feature, {s6('avg(value)')} AS value FROM rolled GROUP BY 1, 2")
def group_series(spark, sf):
    """Mean series per feature."""
    return M.group_series(_base(spark, sf), "feature").select("date", "feature", r6("value").alias("value"))


EV_OPTS = M.AggOptions(how_within="tf-idf", how_docs="equal_weight", how_time=("equal_weight", "linear"), by="day",
                       lag=1, fill="none", ignore_zeros=True)


def _event_sql():
    return _pre() + Q.TIMELINE + """,
ev AS (SELECT event, strftime(date, '%Y-%m') AS mk FROM timeline),
corpus_ev AS (SELECT e.event, c.id, c.date FROM corpus c JOIN ev e ON strftime(c.date, '%Y-%m') = e.mk),
""" + Q.units_sql() + """,
ev_units AS (SELECT e.event, u.* FROM units u JOIN corpus_ev e ON e.id = u.id),
ndocs AS (SELECT event, count(*) AS n FROM corpus_ev GROUP BY 1),
dfreq AS (SELECT event, kind, unit, count(DISTINCT id) AS df FROM ev_units GROUP BY 1, 2, 3),
raw AS (SELECT u.event, u.id, l.lexicon, sum(u.factor * l.y * log10(n.n / d.df)) AS s
  FROM ev_units u JOIN lex l ON l.x = u.unit JOIN dfreq d ON d.event = u.event AND d.kind = u.kind AND d.unit = u.unit
  JOIN ndocs n ON n.event = u.event GROUP BY 1, 2, 3),
lexnames AS (SELECT DISTINCT lexicon FROM lex),
doc_scores AS (SELECT e.event, e.id, e.date, w.word_count, n.lexicon,
  CASE WHEN w.word_count = 0 THEN 0.0 ELSE coalesce(r.s, 0.0) / w.word_count END AS score
  FROM corpus_ev e JOIN wc w ON w.id = e.id CROSS JOIN lexnames n
  LEFT JOIN raw r ON r.event = e.event AND r.id = e.id AND r.lexicon = n.lexicon),
doc_sent AS (SELECT s.event, s.id, s.date, s.word_count, s.lexicon, f.feature, s.score * f.w AS score
  FROM doc_scores s JOIN feats f ON f.id = s.id),
per_period AS (SELECT event, date, lexicon, feature,
  coalesce(sum(score) FILTER (WHERE score <> 0) / nullif(count(*) FILTER (WHERE score <> 0), 0), 0.0) AS value
  FROM doc_sent GROUP BY 1, 2, 3, 4)
SELECT event, date, lexicon, feature, t.time, """ + s6("value") + """ AS value
FROM per_period CROSS JOIN (VALUES ('equal_weight'), ('linear')) AS t(time)"""


@register("event_month_measures", _event_sql())
def event_month_measures(spark, sf):
    """O127: measures of the documents of each event's month, idf taken over
    each event's own documents (event is one more grouping key)."""
    ev = M.event_month_corpus(corpus(spark, sf), fx.timeline(spark))
    ds = S.document_sentiment(ev, lexicons(spark), fx.valence(spark), fx.STOPWORDS, "tf-idf",
                              group_cols=["event"])
    m = M.aggregate_measures(ds, EV_OPTS, extra_keys=["event"])
    return m.select("event", "date", "lexicon", "feature", "time", r6("value").alias("value"))
