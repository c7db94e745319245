"""Registered queries: regression, selection, evaluation, attribution
(O105–O125).  Saturated logits on the F10 table have closed forms, which
are the oracles; fits without one are rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as A
from ..operators import measures as M
from ..operators import models as MD
from ..operators.sentiment import document_sentiment
from ..sources import fixtures as fx
from . import sql as Q
from .common import LEX_NAMES, corpus, lexicons, r6
from .q_measures import BASE, BASE_SQL, CLUSTERS, _base, _base_once
from .q_target import ALIGNED_SQL, _design, target_monthly
from .registry import register
from ..session import materialize

D4 = 4


def r4(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, D4) + F.lit(0.0)


def s4(e: str) -> str:
    return f"(round({e}, {D4}) + 0.0)"


MODEL_SQL = """WITH mt AS (SELECT l.doc_id, CAST(l.quality AS INTEGER) AS label, CAST(l.toxic AS DOUBLE) AS x1,
  CAST(d.lang = 'en' AS DOUBLE) AS x2 FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
cells AS (SELECT x1, x2, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0
  FROM mt GROUP BY 1, 2),
c1 AS (SELECT x1, sum(n1) AS n1, sum(n0) AS n0 FROM cells GROUP BY 1),
b AS (SELECT (SELECT ln(n1 / n0) FROM c1 WHERE x1 = 0) AS b0,
             (SELECT ln(n1 / n0) FROM c1 WHERE x1 = 1) - (SELECT ln(n1 / n0) FROM c1 WHERE x1 = 0) AS b1,
             (SELECT sqrt(1.0 / n1 + 1.0 / n0) FROM c1 WHERE x1 = 0) AS se0,
             (SELECT sqrt(sum(1.0 / n1 + 1.0 / n0)) FROM c1) AS se1)
"""


def _mt(spark, sf):
    return fx.model_table(spark, sf)


def _fit1(spark, sf):
    return MD.logit_fit(_mt(spark, sf), "label", ["x1"])


def _coefs1(spark, sf):
    return MD.coef_table(spark, _fit1(spark, sf), ["x1"])


@register("logit_fit", MODEL_SQL + f"""SELECT '(Intercept)' AS term, {s4('b0')} AS estimate, {s4('se0')} AS std_error,
  {s4('b0 / se0')} AS z_value FROM b UNION ALL
SELECT 'x1', {s4('b1')}, {s4('se1')}, {s4('b1 / se1')} FROM b""")
def logit_fit(spark, sf):
    """O105: quality ~ toxic, binomial logit (saturated: closed-form oracle)."""
    return _coefs1(spark, sf).select("term", r4("estimate").alias("estimate"), r4("std_error").alias("std_error"),
                                     r4("z_value").alias("z_value"))


NULL_SQL = MODEL_SQL + """, p AS (SELECT avg(label) AS p, sum(label) AS n1, count(*) AS n FROM mt),
nul AS (SELECT ln(p / (1 - p)) AS estimate, -2 * (n1 * ln(p) + (n - n1) * ln(1 - p)) AS deviance FROM p)
"""


@register("logit_null", NULL_SQL + f"SELECT {s4('estimate')} AS estimate, {s4('deviance')} AS deviance, "
          f"{s4('deviance + 2')} AS aic FROM nul")
def logit_null(spark, sf):
    """O106: intercept-only logit."""
    n = MD.logit_null(_mt(spark, sf), "label")
    return n.select(*[r4(c).alias(c) for c in n.columns])


def _cell(x1, x2, f):
    return f"(SELECT {f} FROM cells WHERE x1 = {x1} AND x2 = {x2})"


L = {k: _cell(*k, "ln(CAST(n1 AS DOUBLE) / n0)") for k in [(0, 0), (0, 1), (1, 0), (1, 1)]}
V = {k: _cell(*k, "1.0 / n1 + 1.0 / n0") for k in [(0, 0), (0, 1), (1, 0), (1, 1)]}


@register("logit_interactions", MODEL_SQL + f"""SELECT '(Intercept)' AS term, {s4(L[0, 0])} AS estimate,
  {s4(f'sqrt({V[0, 0]})')} AS std_error UNION ALL
SELECT 'x1', {s4(f'{L[1, 0]} - {L[0, 0]}')}, {s4(f'sqrt({V[1, 0]} + {V[0, 0]})')} UNION ALL
SELECT 'x2', {s4(f'{L[0, 1]} - {L[0, 0]}')}, {s4(f'sqrt({V[0, 1]} + {V[0, 0]})')} UNION ALL
SELECT 'x1:x2', {s4(f'{L[1, 1]} - {L[1, 0]} - {L[0, 1]} + {L[0, 0]}')},
  {s4(f'sqrt({V[0, 0]} + {V[0, 1]} + {V[1, 0]} + {V[1, 1]})')}""")
def logit_interactions(spark, sf):
    """O107: quality ~ toxic * english (product term ``x1:x2``)."""
    mt, names = MD.with_interactions(_mt(spark, sf).select("label", "x1", "x2"), [("x1", "x2")])
    cols = ["x1", "x2"] + names
    c = MD.coef_table(spark, MD.logit_fit(mt, "label", cols), cols)
    return c.select("term", r4("estimate").alias("estimate"), r4("std_error").alias("std_error"))


@register("mcfadden_r2", NULL_SQL + """, ll AS (SELECT sum(n1 * ln(n1 / (n1 + n0)) + n0 * ln(n0 / (n1 + n0))) AS ll
  FROM c1)
SELECT """ + s4("-2 * ll + 4") + " AS aic, " + s4("-2 * ll") + " AS deviance, " + s4("(SELECT deviance FROM nul)") +
          " AS null_deviance, " + s4("1 - (-2 * ll) / (SELECT deviance FROM nul)") + " AS mcfadden FROM ll")
def mcfadden_r2(spark, sf):
    """O110: AIC, deviances and McFadden's R² of quality ~ toxic."""
    st = MD.fit_stats(spark, _fit1(spark, sf))
    return st.select(*[r4(c).alias(c) for c in st.columns])


@register("wald_term_test", MODEL_SQL + f"SELECT 'x1' AS term, {s4('(b1 / se1) * (b1 / se1)')} AS wald, 1 AS df FROM b")
def wald_term_test(spark, sf):
    """O111: Wald test of the toxic term."""
    w = MD.wald_term_test(_coefs1(spark, sf), "x1")
    return w.select("term", r4("wald").alias("wald"), "df")


@register("var_importance", MODEL_SQL + f"SELECT 'x1' AS term, {s4('abs(b1 / se1)')} AS importance FROM b")
def var_importance(spark, sf):
    """O112: |z| per regressor."""
    v = MD.var_importance(_coefs1(spark, sf))
    return v.select("term", r4("importance").alias("importance"))


@register("fitted_vs_actual", MODEL_SQL + f"""SELECT m.doc_id, {s4('c.n1 / (c.n1 + c.n0)')} AS fitted, m.label,
  CAST(c.n1 / (c.n1 + c.n0) >= 0.5 AS INTEGER) AS above_half FROM mt m JOIN c1 c ON c.x1 = m.x1""")
def fitted_vs_actual(spark, sf):
    """O113: fitted probability per row vs the label."""
    mt = _mt(spark, sf)
    f = MD.fitted_vs_actual(_fit1(spark, sf), mt, "label", ["x1"], "doc_id")
    return f.select("doc_id", r4("fitted").alias("fitted"), "label", "above_half")


GLOBS = [f"glob_{c}" for c in CLUSTERS]


def _design_fixed(spark, sf):
    """The design table (periods × regressors) materialised once in the
    checkpoint folder, so the many small fits below do not re-run the text
    pipeline behind it."""
    return materialize(_design(spark, sf, round_=False))


@register("design_stepwise_aic", None)
def design_stepwise_aic(spark, sf):
    """O108 on the design table: both-direction AIC selection over the cluster indices."""
    trace = MD.stepwise_aic(_design_fixed(spark, sf), "label", GLOBS)
    return spark.createDataFrame(trace, STEP_SCHEMA)


@register("design_stepwise_aic_2way", None)
def design_stepwise_aic_2way(spark, sf):
    """O109 on the design table: the same with all two-way interactions in scope."""
    trace = MD.stepwise_aic(_design_fixed(spark, sf), "label", GLOBS, MD.pairwise_scope(GLOBS))
    return spark.createDataFrame(trace, STEP_SCHEMA)


STEP_SCHEMA = "step int, action string, term string, aic double"
DUMMIES = {"d_de": "de", "d_es": "es", "d_fr": "fr"}
# any set of dummies of one factor pools the other languages, so its logit is saturated
STEP_SQL = "WITH RECURSIVE" + MODEL_SQL[len("WITH"):] + f""", lg AS (SELECT CASE {' '.join(f"WHEN d.lang = '{v}' THEN {1 << i}" for i, v in enumerate(DUMMIES.values()))} ELSE 0 END AS bit,
  CAST(l.quality AS INTEGER) AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
pooled AS (SELECT m.mask, CASE WHEN bit & m.mask > 0 THEN bit ELSE 0 END AS cell, sum(label) AS n1, count(*) - sum(label) AS n0
  FROM lg CROSS JOIN (SELECT unnest(range({1 << len(DUMMIES)})) AS mask) m GROUP BY 1, 2),
aics AS (SELECT mask, -2 * sum(n1 * ln(n1 / (n1 + n0)) + n0 * ln(n0 / (n1 + n0))) + 2 * (1 + bit_count(mask)) AS aic FROM pooled GROUP BY 1),
moves AS (SELECT a.mask, a.aic AS before, CASE WHEN a.mask & t.bit > 0 THEN '-' ELSE '+' END AS action, t.term, b.mask AS after, b.aic,
  row_number() OVER (PARTITION BY a.mask ORDER BY b.aic, CASE WHEN a.mask & t.bit > 0 THEN '-' ELSE '+' END, t.term) AS rn
  FROM aics a CROSS JOIN (VALUES {', '.join(f"('{k}', {1 << i})" for i, k in enumerate(DUMMIES))}) AS t(term, bit) JOIN aics b ON b.mask = xor(a.mask, t.bit)),
walk AS (SELECT 0 AS step, 'start' AS action, '' AS term, {(1 << len(DUMMIES)) - 1} AS mask, aic FROM aics WHERE mask = {(1 << len(DUMMIES)) - 1}
  UNION ALL SELECT w.step + 1, m.action, m.term, m.after, m.aic FROM walk w JOIN moves m ON m.mask = w.mask AND m.rn = 1 WHERE m.aic < w.aic - 1e-9)
SELECT step, action, term, """ + s4("aic") + " AS aic FROM walk"


def _stepwise(spark, sf, scope):
    docs = fx.table(spark, sf, "documents").select("doc_id", *[(F.col("lang") == v).cast("double").alias(k) for k, v in DUMMIES.items()])
    table = fx.table(spark, sf, "labels").join(docs, "doc_id").select(F.col("quality").cast("int").alias("label"), *DUMMIES)
    trace = MD.stepwise_aic(table, "label", list(DUMMIES), scope)
    return spark.createDataFrame(trace, STEP_SCHEMA).withColumn("aic", r4("aic"))


@register("stepwise_aic", STEP_SQL)
def stepwise_aic(spark, sf):
    """O108: both-direction AIC selection over the language dummies of quality."""
    return _stepwise(spark, sf, None)


@register("stepwise_aic_2way", STEP_SQL)
def stepwise_aic_2way(spark, sf):
    """O109: the same with two-way interactions in scope; dummies of one factor
    never meet, so these are collinear and no candidate."""
    return _stepwise(spark, sf, MD.pairwise_scope(list(DUMMIES)))


def _measure_cols(dm):
    return [c for c in dm.columns if "--" in c]


N_LAMBDAS = 100


def _path(dm, cols, n=N_LAMBDAS):
    return MD.lambda_path(dm, "label", cols, n)


def _slices(df, cols, order="date"):
    rows = MD.timeslice_cv(df, "label", cols, _path(df, cols), 60, 10, order)
    best = MD.best_lambda(rows)
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows],
                                           "lambda double, slice int, error double, reason string, chosen boolean")


def _choice(df, cols, k):
    """λ.min, its error and the coefficients of the refit at λ.min."""
    best, curve = MD.lasso_kfold(df, "label", cols, _path(df, cols), k=k)
    model = MD.sparse_fit(df, "label", cols, best)
    error = next(e for lam, e, _ in curve if lam == best)
    terms = [("(Intercept)", float(model.intercept)), *zip(cols, map(float, model.coefficients))]
    return df.sparkSession.createDataFrame([(best, error, float(model.getRegParam()), t, b) for t, b in terms],
                                           "lambda_min double, cv_error double, fitted_reg double, term string, beta double")


def _curve(df, cols, k):
    _, curve = MD.lasso_kfold(df, "label", cols, _path(df, cols), k=k)
    return df.sparkSession.createDataFrame(curve, "lambda double, cv_error double, cv_se double")


def _folds(spark, sf, k):
    dm = _design_fixed(spark, sf).withColumn("fold", ((F.year("date") * 12 + F.month("date")) % k).cast("int"))
    return dm, GLOBS + _measure_cols(dm)


@register("design_timeslice_cv", None)
def design_timeslice_cv(spark, sf):
    """O114 on the design table: LASSO logit, rolling origin (train 60, test 10 periods)."""
    dm = _design_fixed(spark, sf)
    return _slices(dm, GLOBS + _measure_cols(dm))


@register("design_kfold_cv", None)
def design_kfold_cv(spark, sf):
    """O115 on the design table: LASSO logit, 10-fold CV on misclassification."""
    return _choice(*_folds(spark, sf, 10), 10)


@register("design_cv_curve", None)
def design_cv_curve(spark, sf):
    """O116 on the design table: mean 5-fold CV error and its standard error per λ."""
    return _curve(*_folds(spark, sf, 5), 5)


# a LASSO logit of one binary regressor has a closed form: the penalty takes λ·sd·n/n1 from the share of
# positives where x = 1 and gives λ·sd·n/n0 to that where x = 0, until both are the overall share
PATH_SQL = """WITH mt AS (SELECT l.doc_id, CAST(l.quality AS INTEGER) AS y, CAST(l.toxic AS INTEGER) AS x,
  date_trunc('month', CAST(DATE '1995-01-01' + CAST((l.doc_id * 41) % 2405 AS INTEGER) AS DATE)) AS month
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
lam AS (SELECT i, (SELECT abs(sum(x * y) - avg(y) * sum(x)) / (count(*) * stddev_samp(x)) FROM mt) * power(0.01, i / {last}) AS lm
  FROM (SELECT unnest(range({n})) AS i)),
{groups},
tr AS (SELECT g, count(*) AS n, sum(x) AS n1, count(*) - sum(x) AS n0, avg(y) AS yb, sum(x * y) AS p1, sum(y) - sum(x * y) AS p0,
  coalesce(stddev_samp(x), 0) AS sd FROM train GROUP BY 1),
fit AS (SELECT tr.*, lam.i, lam.lm, CASE WHEN n1 = 0 OR n0 = 0 OR lm >= abs(p1 - yb * n1) / (n * sd) THEN yb
    ELSE p1 / n1 - sign(p1 / n1 - p0 / n0) * lm * sd * n / n1 END AS s1,
  CASE WHEN n1 = 0 OR n0 = 0 OR lm >= abs(p1 - yb * n1) / (n * sd) THEN yb
    ELSE p0 / n0 + sign(p1 / n1 - p0 / n0) * lm * sd * n / n0 END AS s0 FROM tr CROSS JOIN lam),
err AS (SELECT f.g, f.i, f.lm, CASE WHEN f.yb IN (0, 1) THEN NULL
  ELSE avg(CAST((CASE WHEN t.x = 1 THEN f.s1 ELSE f.s0 END > 0.5) <> (t.y = 1) AS INTEGER)) END AS error
  FROM fit f JOIN test t ON t.g = f.g GROUP BY f.g, f.i, f.lm, f.yb),
curve AS (SELECT i, lm, avg(error) AS cv_error, stddev_samp(error) / sqrt(count(error)) AS cv_se FROM err GROUP BY 1, 2),
best AS (SELECT lm, cv_error FROM curve WHERE cv_error IS NOT NULL ORDER BY round(cv_error, 12), lm DESC LIMIT 1)
""".replace("{n}", str(N_LAMBDAS)).replace("{last}", f"{N_LAMBDAS - 1}.0")


def _fold_groups(k):
    return (f"train AS (SELECT f.g, mt.* FROM mt JOIN (SELECT unnest(range({k})) AS g) f ON mt.doc_id % {k} <> f.g), "
            f"test AS (SELECT doc_id % {k} AS g, * FROM mt)")


SLICE_GROUPS = """ranked AS (SELECT mt.*, r.t FROM mt JOIN (SELECT month, row_number() OVER (ORDER BY month) - 1 AS t FROM (SELECT DISTINCT month FROM mt)) r USING (month)),
starts AS (SELECT unnest(range(greatest((SELECT max(t) FROM ranked) + 2 - 70, 0))) AS g),
train AS (SELECT s.g, r.* FROM ranked r JOIN starts s ON r.t >= s.g AND r.t < s.g + 60),
test AS (SELECT s.g, r.* FROM ranked r JOIN starts s ON r.t >= s.g + 60 AND r.t < s.g + 70)"""


def _binary(spark, sf, k):
    """The labelled documents: quality by one binary regressor, folds by id, months."""
    month = fx.corpus(spark, sf).select(F.col("id").alias("doc_id"), F.trunc("date", "month").alias("month"))
    return _mt(spark, sf).select("doc_id", "label", "x1").join(month, "doc_id").withColumn("fold", (F.col("doc_id") % k).cast("int"))


@register("sparse_timeslice_cv", PATH_SQL.replace("{groups}", SLICE_GROUPS) + f"""SELECT {s4('e.lm')} AS "lambda", CAST(e.g AS INTEGER) AS slice, {s4('e.error')} AS error,
  CASE WHEN e.error IS NULL THEN 'one class in training' END AS reason, e.lm = b.lm AS chosen FROM err e CROSS JOIN best b""")
def sparse_timeslice_cv(spark, sf):
    """O114: LASSO logit path of 100 λ, rolling origin over months (train 60, test 10)."""
    rows = _slices(_binary(spark, sf, 1), ["x1"], "month")
    return rows.withColumns({c: r4(c) for c in ("lambda", "error")})


@register("sparse_kfold_cv", PATH_SQL.replace("{groups}", _fold_groups(10)) + f""", whole AS (SELECT count(*) AS n, sum(x) AS n1, count(*) - sum(x) AS n0, avg(y) AS yb,
  sum(x * y) AS p1, sum(y) - sum(x * y) AS p0, stddev_samp(x) AS sd FROM mt),
refit AS (SELECT b.lm, b.cv_error, CASE WHEN b.lm >= abs(p1 - yb * n1) / (n * sd) * (1 - 1e-12) THEN yb ELSE p1 / n1 - sign(p1 / n1 - p0 / n0) * b.lm * sd * n / n1 END AS s1,
  CASE WHEN b.lm >= abs(p1 - yb * n1) / (n * sd) * (1 - 1e-12) THEN yb ELSE p0 / n0 + sign(p1 / n1 - p0 / n0) * b.lm * sd * n / n0 END AS s0 FROM whole CROSS JOIN best b)
SELECT {s4('lm')} AS lambda_min, {s4('cv_error')} AS cv_error, {s4('lm')} AS fitted_reg, term, {s4('beta')} AS beta FROM (
  SELECT lm, cv_error, '(Intercept)' AS term, ln(s0 / (1 - s0)) AS beta FROM refit
  UNION ALL SELECT lm, cv_error, 'x1', ln(s1 / (1 - s1)) - ln(s0 / (1 - s0)) FROM refit)""")
def sparse_kfold_cv(spark, sf):
    """O115: LASSO logit, 100 λ, 10-fold CV on misclassification: λ.min, its
    error and the coefficients of the refit at λ.min."""
    out = _choice(_binary(spark, sf, 10), ["x1"], 10)
    return out.withColumns({c: r4(c) for c in ("lambda_min", "cv_error", "fitted_reg", "beta")})


@register("cv_curve", PATH_SQL.replace("{groups}", _fold_groups(5)) + f'SELECT {s4("lm")} AS "lambda", {s4("cv_error")} AS cv_error, {s4("cv_se")} AS cv_se FROM curve')
def cv_curve(spark, sf):
    """O116: mean 5-fold CV error and its standard error for 100 λ."""
    out = _curve(_binary(spark, sf, 5), ["x1"], 5)
    return out.withColumns({c: r4(c) for c in out.columns})


@register("sparse_coefficients", MODEL_SQL + """, mt3 AS (SELECT avg(label) AS p FROM mt)
SELECT '(Intercept)' AS term, """ + s4("ln(p / (1 - p))") + """ AS beta FROM mt3
UNION ALL SELECT 'x1', 0.0 UNION ALL SELECT 'x2', 0.0 UNION ALL SELECT 'x3', 0.0""")
def sparse_coefficients(spark, sf):
    """O117: LASSO coefficients at λ ≥ λmax: only the intercept is left."""
    mt = _mt(spark, sf)
    cols = ["x1", "x2", "x3"]
    lam = MD.lambda_max(mt, "label", cols) * 1.01 + 1e-12
    m = MD.sparse_fit(mt, "label", cols, lam)
    rows = [("(Intercept)", float(m.intercept))] + [(c, float(b)) for c, b in zip(cols, m.coefficients)]
    return spark.createDataFrame(rows, "term string, beta double").select("term", r4("beta").alias("beta"))


# --- prediction and attribution with literal coefficients (F11) -----------------
B0 = fx.COEF_INTERCEPT
LINK_SQL = BASE_SQL + f""", {Q.COEFS},
named AS (SELECT date, lexicon, feature, time, lexicon || '--' || feature || '--' || time AS measure, value FROM rolled),
contrib AS (SELECT n.date, n.lexicon, n.feature, n.time, c.beta * n.value AS bv FROM named n
  JOIN coefs c ON c.measure = n.measure),
scheme_weights AS ({" UNION ALL ".join(f"SELECT {Q.q(n)} AS time, {Q.weights_sql(n, BASE.lag, 3)} AS w" for n in BASE.schemes())}),
link AS (SELECT d.date, {B0!r} + coalesce(s.s, 0.0) AS link FROM (SELECT DISTINCT date FROM rolled) d
  LEFT JOIN (SELECT date, sum(bv) AS s FROM contrib GROUP BY 1) s ON s.date = d.date)
"""


def _coefs(spark):
    return fx.coefficients(spark)


def _link(spark, sf, base=None):
    return A.predict_link(base if base is not None else _base(spark, sf), _coefs(spark), B0)


@register("predict_link", LINK_SQL + "SELECT date, " + r"(round(link, 6) + 0.0)" + " AS link FROM link")
def predict_link(spark, sf):
    """O119: b0 + Σ beta·measure per date with the F11 coefficients."""
    return _link(spark, sf).select("date", r6("link").alias("link"))


@register("predict_class", LINK_SQL + "SELECT date, CAST(link >= 0 AS INTEGER) AS pred FROM link")
def predict_class(spark, sf):
    """O118: class prediction (probability ≥ 0.5)."""
    return A.predict_class(_link(spark, sf))


CONF_SQL = ALIGNED_SQL + LINK_SQL.replace(BASE_SQL, "")


@register("confusion_scores", CONF_SQL + """, j AS (SELECT CAST(l.link >= 0 AS INTEGER) AS p, t.label AS y FROM link l
  JOIN target t ON t.date = l.date)
SELECT count(*) FILTER (WHERE p = 1 AND y = 1) AS TP, count(*) FILTER (WHERE p = 0 AND y = 0) AS TN,
  count(*) FILTER (WHERE p = 1 AND y = 0) AS FP, count(*) FILTER (WHERE p = 0 AND y = 1) AS FN,
  """ + "\n".join([]) + """(round(count(*) FILTER (WHERE p = 1 AND y = 1) / nullif(CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE), 0), 6) + 0.0) AS TPR,
  (round(count(*) FILTER (WHERE p = 0 AND y = 0) / nullif(CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE), 0), 6) + 0.0) AS TNR,
  (round(count(*) FILTER (WHERE p = y) / CAST(count(*) AS DOUBLE), 6) + 0.0) AS accuracy FROM j""")
def confusion_scores(spark, sf):
    """O120: confusion counts and rates against the volume-event target."""
    base = _base_once(spark, sf)
    c = A.confusion_scores(A.predict_class(_link(spark, sf, base)), target_monthly(spark, sf))
    return c.select("TP", "TN", "FP", "FN", r6("TPR").alias("TPR"), r6("TNR").alias("TNR"),
                    r6("accuracy").alias("accuracy"))


@register("binary_plot_table", CONF_SQL + """, j AS (SELECT l.date, t.label AS tru, CAST(l.link >= 0 AS INTEGER) AS pred
  FROM link l JOIN target t ON t.date = l.date)
SELECT date, 'true' AS variable, tru AS value FROM j UNION ALL SELECT date, 'predicted', pred FROM j""")
def binary_plot_table(spark, sf):
    """O121: (date, true, predicted) in long form."""
    base = _base_once(spark, sf)
    return A.binary_plot_table(A.predict_class(_link(spark, sf, base)), target_monthly(spark, sf))


@register("attribution", LINK_SQL + "SELECT d.date, " + ", ".join(
    f"(round(coalesce(sum(c.bv) FILTER (WHERE c.lexicon = {Q.q(x)}), 0.0), 6) + 0.0) AS {x}" for x in LEX_NAMES) +
          " FROM (SELECT DISTINCT date FROM rolled) d LEFT JOIN contrib c ON c.date = d.date GROUP BY d.date")
def attribution(spark, sf):
    """O122: attribution per date and lexicon, one column per lexicon."""
    a = A.attribution(_base(spark, sf), _coefs(spark), "lexicon", LEX_NAMES)
    return a.select("date", *[r6(x).alias(x) for x in LEX_NAMES])


@register("attribution_all_dims", LINK_SQL + """SELECT date, 'lexicon' AS dim, lexicon AS member,
  (round(sum(bv), 6) + 0.0) AS attrib FROM contrib GROUP BY 1, 2, 3
UNION ALL SELECT date, 'feature', feature, (round(sum(bv), 6) + 0.0) FROM contrib GROUP BY 1, 2, 3
UNION ALL SELECT date, 'time', time, (round(sum(bv), 6) + 0.0) FROM contrib GROUP BY 1, 2, 3
UNION ALL SELECT f.date, 'lag', CAST(b.back AS VARCHAR), (round(sum(c.beta * w.w[b.lag - b.back] / list_sum(w.w)
  * f.v[b.lag - b.back]), 6) + 0.0) FROM framed f JOIN scheme_weights w ON true
  JOIN coefs c ON c.measure = f.lexicon || '--' || f.feature || '--' || w.time
  JOIN (SELECT unnest(range(0, len(w))) AS back, len(w) AS lag FROM (SELECT w FROM scheme_weights LIMIT 1)) b ON true
  GROUP BY 1, 2, 3""")
def attribution_all_dims(spark, sf):
    """O123: attributions by lexicon, feature and time (grouping sets), and by
    lag (the share of each period in the windows)."""
    per = M.aggregate_documents(document_sentiment(corpus(spark, sf), lexicons(spark), fx.valence(spark), fx.STOPWORDS,
                                                   BASE.how_within, BASE.units, BASE.phrase_mode),
                                BASE.by, BASE.how_docs, BASE.ignore_zeros)
    filled = materialize(M.fill_periods(per, BASE.by, BASE.fill, ends=M.period_ends(corpus(spark, sf), BASE.by)), "filled")
    schemes = BASE.schemes()
    a = A.attribution_all_dims(M.roll_series(filled, schemes), _coefs(spark)).unionByName(
        A.attribution_by_lag(filled, schemes, _coefs(spark)))
    return a.select("date", "dim", "member", r6("attrib").alias("attrib"))


@register("attribution_check", LINK_SQL + f"""SELECT l.date, (round(l.link - {B0!r} - coalesce(s.s, 0.0), 6) + 0.0)
  AS residual FROM link l LEFT JOIN (SELECT date, sum(bv) AS s FROM contrib GROUP BY 1) s ON s.date = l.date""")
def attribution_check(spark, sf):
    """O124: link − intercept − Σ attributions per date (≈ 0)."""
    base = _base_once(spark, sf)
    chk = A.attribution_check(_link(spark, sf, base), A.attribution(base, _coefs(spark), "lexicon"), B0)
    return chk.select("date", r6("residual").alias("residual"))


@register("attribution_plot_table", LINK_SQL + """, al AS (SELECT date, lexicon AS variable, sum(bv) AS value
  FROM contrib GROUP BY 1, 2),
rk AS (SELECT variable, dense_rank() OVER (ORDER BY variable) AS rank FROM (SELECT DISTINCT variable FROM al))
SELECT a.date, a.variable, (round(a.value, 6) + 0.0) AS value, r.rank,
  (SELECT count(*) FROM rk) <= 12 AS legend FROM al a JOIN rk r USING (variable)""")
def attribution_plot_table(spark, sf):
    """O125: melted attributions with variable rank and legend rule."""
    t = A.attribution_plot_table(A.attribution(_base(spark, sf), _coefs(spark), "lexicon"))
    return t.select("date", "variable", r6("value").alias("value"), F.col("rank").cast("long").alias("rank"),
                    "legend")
