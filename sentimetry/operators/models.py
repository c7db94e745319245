"""Regression, selection and evaluation (O105–O118) on MLlib.

Single fits run in MLlib (IRLS for the GLM, OWL-QN for the sparse logit).
Selection and cross-validation fit many models to one small table: while its
counted cells stay under ``SENT_CELLS`` the table is sent to the tasks and the
models are dealt to them, so a grid of folds and λ, or all candidates of a
step, are one job.  Larger tables stay where they are: MLlib fits one model
after the other.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


SENT_CELLS = 4_000_000  # rows x regressors of a table sent to the tasks: 32 MB


def _sent(df: DataFrame, label: str, cols: list[str], *more: str, cells: int):
    """(regressors, labels, more columns) as arrays, or None if over ``cells``."""
    if df.count() * max(1, len(cols)) > cells:
        return None
    double = lambda c: F.col(f"`{c}`").cast("double")
    table = df.select(double(label).alias("y"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(more)], *[double(c).alias(f"x{i}") for i, c in enumerate(cols)]).toArrow()
    of = lambda c: table.column(c).to_numpy()
    x = np.stack([of(f"x{i}") for i in range(len(cols))], axis=1) if cols else np.zeros((table.num_rows, 0))
    return x, of("y"), [of(f"m{i}") for i in range(len(more))]


BLOCK_CELLS = 1 << 20  # rows x models worked on at once: 8 MB


def _row_blocks(rows: int, models: int) -> list[slice]:
    step = max(1, BLOCK_CELLS // max(1, models))
    return [slice(at, at + step) for at in range(0, rows, step)]


def _misclassified(x: np.ndarray, y: np.ndarray, b: np.ndarray) -> list[float | None]:
    """Share of the rows that each of the models ``b`` gets wrong."""
    wrong = sum(((b[0] + x[at] @ b[1:] > 0) != y[at, None]).sum(axis=0) for at in _row_blocks(len(y), b.shape[1]))
    return (wrong / len(y)).tolist() if len(y) else [None] * b.shape[1]


def lasso_path(x: np.ndarray, y: np.ndarray, lambdas: list[float], steps: int = 20_000, tol: float = 1e-10) -> np.ndarray:
    """LASSO logits at all ``lambdas`` side by side: (1 + regressors) x lambdas,
    the intercept first, on the regressors' own scale.  Penalties hold for
    regressors divided by their standard deviation.  Accelerated proximal
    gradient; a model's momentum restarts where it points uphill.  Equal rows are
    one row with a weight, and a step takes ``BLOCK_CELLS`` cells at a time."""
    n, lam = len(y), np.array(lambdas)
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    live = sd > 0
    some, times = np.unique(np.column_stack([x[:, live], y]), axis=0, return_counts=True)
    a, y = np.column_stack([np.ones(len(some)), (some[:, :-1] - mean[live]) / sd[live]]), some[:, -1]
    weighed = a * times[:, None]
    rate = 4 * n / np.linalg.eigvalsh(weighed.T @ a)[-1]
    blocks = _row_blocks(len(a), len(lam))
    limit = rate * np.vstack([0 * lam, np.broadcast_to(lam, (a.shape[1] - 1, len(lam)))])
    b = np.zeros((a.shape[1], len(lam)))
    z, t = b, np.ones(len(lam))
    for _ in range(steps):
        slope = sum(weighed[at].T @ (1 / (1 + np.exp(-np.clip(a[at] @ z, -500, 500))) - y[at, None]) for at in blocks)
        to = z - rate / n * slope
        to = np.sign(to) * np.maximum(np.abs(to) - limit, 0)
        move = to - b
        t = np.where(((z - to) * move).sum(axis=0) > 0, 1.0, t)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, b, t = to + (t - 1) / after * move, to, after
        if np.abs(move).max(initial=0) < tol:
            break
    out = np.zeros((1 + x.shape[1], len(lam)))
    out[1:][live] = b[1:] / sd[live][:, None]
    out[0] = b[0] - mean @ out[1:]
    return out


def _grid_errors(spark: SparkSession, x: np.ndarray, y: np.ndarray, groups: list[int], split: Callable, lambdas: list[float]) -> list[tuple[int, int, float | None]]:
    """(group, number of λ, misclassification of the group's test rows) of a path
    fitted to each group's training rows, one job; ``split``: group -> (training,
    test) masks.  None where the training rows have one class."""
    sent = spark.sparkContext.broadcast((x, y))  # rows x regressors is bounded

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = sent.value
        for batch in batches:
            for group in batch.column("id").to_pylist():
                train, test = split(group)
                if len(np.unique(y[train])) < 2:
                    error = [None] * len(lambdas)
                else:
                    error = _misclassified(x[test], y[test], lasso_path(x[train], y[train], lambdas))
                yield pa.record_batch([pa.array([group] * len(lambdas), pa.int64()), pa.array(range(len(lambdas)), pa.int64()), pa.array(error, pa.float64())], names=["g", "i", "error"])

    if not groups:
        return []
    rows = spark.createDataFrame([(g,) for g in groups], "id long").repartitionByRange(len(groups), "id").mapInArrow(errors, "g long, i long, error double").collect()
    sent.unpersist()
    return sorted(((r["g"], r["i"], r["error"]) for r in rows), key=lambda r: r[:2])


def _aic(x: np.ndarray, y: np.ndarray) -> float:
    """AIC of a binomial logit by IRLS; infinite where the regressors are
    collinear or separate the classes."""
    a = np.column_stack([np.ones(len(y)), x])
    if np.linalg.matrix_rank(a) < a.shape[1]:
        return math.inf
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        try:
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a, a.T @ (y - p))
        except np.linalg.LinAlgError:
            return math.inf
        b = b + step
        if not np.isfinite(b).all():
            return math.inf
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(b).max()):
            eta = a @ b
            return float(2 * a.shape[1] - 2 * (y @ eta - np.logaddexp(0, eta).sum()))
    return math.inf


def _aics(spark: SparkSession, sent, sets: list[list[int]]) -> list[float]:
    """AIC of each set of columns, one job."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = sent.value
        for batch in batches:
            aic = [_aic(x[:, own], y) for own in batch.column("own").to_pylist()]
            yield pa.record_batch([batch.column("id"), pa.array(aic, pa.float64())], names=["id", "aic"])

    rows = spark.createDataFrame(list(enumerate(sets)), "id long, own array<int>").repartitionByRange(len(sets), "id")
    return [r["aic"] for r in sorted(rows.mapInArrow(score, "id long, aic double").collect(), key=lambda r: r["id"])]


def with_interactions(df: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """O107: product columns ``a:b`` for the given pairs."""
    names = []
    for a, b in pairs:
        n = f"{a}:{b}"
        df = df.withColumn(n, F.col(a) * F.col(b))
        names.append(n)
    return df, names


def _assemble(df: DataFrame, label: str, cols: list[str], *more: str) -> DataFrame:
    """``(label, features)`` with regressors taken by exact name (``a:b`` ok)."""
    data = df.select(F.col(label).cast("double").alias("label"), *more,
                     *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(data)


def logit_fit(df: DataFrame, label: str, cols: list[str], tol: float = 1e-10, max_iter: int = 50):
    """O105: binomial-logit GLM; returns the fitted MLlib model."""
    if not cols:
        raise ValueError("use logit_null for the intercept-only model")
    data = _assemble(df, label, cols)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", tol=tol, maxIter=max_iter,
                                      featuresCol="features", labelCol="label")
    return glm.fit(data)


def coef_table(spark: SparkSession, model, cols: list[str]) -> DataFrame:
    """Coefficient table ``(term, estimate, std_error, z_value, p_value)``
    (a handful of numbers from the model summary)."""
    s = model.summary
    est = [float(model.intercept)] + [float(x) for x in model.coefficients]
    names = ["(Intercept)"] + list(cols)
    # MLlib lists standard errors, t and p values with the intercept last
    se = list(s.coefficientStandardErrors)
    tv = list(s.tValues)
    pv = list(s.pValues)
    se = [se[-1]] + se[:-1]
    tv = [tv[-1]] + tv[:-1]
    pv = [pv[-1]] + pv[:-1]
    rows = [(n, e, float(a), float(t), float(p)) for n, e, a, t, p in zip(names, est, se, tv, pv)]
    return spark.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, "
                                       "p_value double")


def fit_stats(spark: SparkSession, model) -> DataFrame:
    """AIC, deviance, null deviance and McFadden's R² (O110)."""
    s = model.summary
    dev, null = float(s.deviance), float(s.nullDeviance)
    return spark.createDataFrame([(float(s.aic), dev, null, 1.0 - dev / null)],
                                 "aic double, deviance double, null_deviance double, mcfadden double")


def logit_null(df: DataFrame, label: str) -> DataFrame:
    """O106: intercept-only logit in closed form: β0 = ln(p/(1−p)),
    deviance = −2 Σ [y ln p + (1−y) ln(1−p)], AIC = deviance + 2."""
    p = F.avg(F.col(label).cast("double"))
    n1 = F.sum(F.col(label).cast("double"))
    n = F.count("*")
    agg = df.agg(p.alias("p"), n1.alias("n1"), n.alias("n"))
    dev = -2 * (F.col("n1") * F.log("p") + (F.col("n") - F.col("n1")) * F.log(1 - F.col("p")))
    return agg.select(F.log(F.col("p") / (1 - F.col("p"))).alias("estimate"), dev.alias("deviance"),
                      (dev + 2).alias("aic"))


def wald_term_test(coefs: DataFrame, term: str) -> DataFrame:
    """O111: Wald statistic (β/SE)² of one term, its df and p value."""
    return coefs.where(F.col("term") == term).select(
        "term", (F.col("z_value") ** 2).alias("wald"), F.lit(1).alias("df"), F.col("p_value"))


def var_importance(coefs: DataFrame) -> DataFrame:
    """O112: |z| of every regressor (the intercept left out)."""
    return coefs.where(F.col("term") != "(Intercept)").select("term", F.abs("z_value").alias("importance"))


def fitted_vs_actual(model, df: DataFrame, label: str, cols: list[str], id_col: str) -> DataFrame:
    """O113: fitted probability, actual label, and the 0.5 line."""
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(
        df.select(id_col, F.col(label).cast("double").alias("label"), *[F.col(c).cast("double") for c in cols]))
    out = model.transform(data)
    return out.select(id_col, F.col("prediction").alias("fitted"), F.col("label").cast("int").alias("label"),
                      (F.col("prediction") >= 0.5).cast("int").alias("above_half"))


def _is_singular(error: Exception) -> bool:
    """Whether a fit failed because its regressors are collinear or separate the
    classes; anything else (a lost executor, say) is no property of the data."""
    text = str(error).lower()
    return any(w in text for w in ("singular", "positive definite", "no solution", "summary", "nan", "infinite"))


def stepwise_aic(df: DataFrame, label: str, full: list[str], scope: list[str] | None = None,
                 cells: int = SENT_CELLS) -> list[tuple[int, str, str, float]]:
    """O108/O109: both-direction selection by AIC from the full model.

    The first model is an MLlib fit; all candidates of a step are scored in one
    job while the design table has at most ``cells`` cells, else fitted one after
    the other.  The driver chooses the next candidate set and ends when none
    lowers the AIC.  Returns the trace
    ``(step, action, term, aic)``.  ``scope`` may hold interaction names
    ``a:b`` (added only when both parents are in, dropped only when no
    interaction above them is in: marginality).
    """
    scope = list(scope or full)
    data = df
    for t in scope:
        if ":" in t and t not in data.columns:
            a, b = t.split(":")
            data = data.withColumn(t, F.col(a) * F.col(b))
    data = data.select(F.col(label), *[F.col(f"`{t}`") for t in scope]).coalesce(1).cache()
    n_aic = logit_null(data, label).first()["aic"]

    def aic(cols):
        if not cols:
            return float(n_aic)
        try:
            m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50, tol=1e-8).fit(
                _assemble(data, label, cols))
            return float(m.summary.aic)
        except Exception as error:  # noqa: BLE001
            if _is_singular(error):  # not a candidate
                return math.inf
            raise

    def allowed_drop(cur, t):
        return not any(":" in u and t in u.split(":") for u in cur if u != t)

    def allowed_add(cur, t):
        return ":" not in t or all(p in cur for p in t.split(":"))

    table = _sent(data, label, scope, cells=cells)
    sent = data.sparkSession.sparkContext.broadcast(table[:2]) if table else None

    def scores(sets: list[list[str]]) -> list[float]:
        if sent is None:
            return [aic(c) for c in sets]
        filled = [c for c in sets if c]
        known = iter(_aics(data.sparkSession, sent, [[scope.index(t) for t in c] for c in filled]) if filled else [])
        return [next(known) if c else float(n_aic) for c in sets]

    cur = list(full)
    best = aic(cur)
    trace = [(0, "start", "", best)]
    for step in itertools.count(1):  # AIC falls at every step, so no set comes back
        cands = [("-", t, [c for c in cur if c != t]) for t in cur if allowed_drop(cur, t)]
        cands += [("+", t, cur + [t]) for t in scope if t not in cur and allowed_add(cur, t)]
        if not cands:
            break
        scored = [(x, a, t, c) for x, (a, t, c) in zip(scores([c for _, _, c in cands]), cands)]
        a_best = min(scored, key=lambda x: (x[0], x[1], x[2]))
        if a_best[0] >= best - 1e-9:
            break
        best, cur = a_best[0], a_best[3]
        trace.append((step, a_best[1], a_best[2], best))
    data.unpersist()
    return trace


def pairwise_scope(cols: list[str]) -> list[str]:
    """``y ~ .^2``: main effects and all two-way interactions."""
    return list(cols) + [f"{a}:{b}" for a, b in itertools.combinations(cols, 2)]


def lambda_path(df: DataFrame, label: str, cols: list[str], n: int = 10, ratio: float = 0.01) -> list[float]:
    """λ from λmax down to ``ratio`` · λmax, evenly on the log scale."""
    top = lambda_max(df, label, cols)
    return [top * ratio ** (i / (n - 1)) for i in range(n)]


def lasso_kfold(df: DataFrame, label: str, cols: list[str], lambdas: list[float], k: int = 10,
                fold_col: str = "fold", cells: int = SENT_CELLS) -> tuple[float, list[tuple[float, float, float]]]:
    """O115/O116: LASSO logit, k-fold CV on misclassification with
    deterministic folds from ``fold_col``.  Returns λ.min (lowest mean error,
    ties to the larger λ) and the curve ``(lambda, cv_error, cv_se)``; refit at
    λ.min with :func:`sparse_fit`.  A fold's whole path is fitted at once, the
    folds in one job, while the table has at most ``cells`` cells; else MLlib's
    cross-validator fits them one by one.  A fold without test rows, or whose
    training rows have one class, has no error and doesn't count."""
    if table := _sent(df, label, cols, fold_col, cells=cells):
        x, y, (fold,) = table
        errors = _grid_errors(df.sparkSession, x, y, list(range(k)), lambda f: (fold != f, fold == f), lambdas)
        curve = []
        for i, lam in enumerate(lambdas):
            own = [e for _, j, e in errors if j == i and e is not None]
            mean = sum(own) / len(own) if own else math.nan
            spread = math.sqrt(sum((e - mean) ** 2 for e in own) / (len(own) - 1) / len(own)) if len(own) > 1 else math.nan
            curve.append((float(lam), mean, spread))
        return min(curve, key=lambda r: (round(r[1], 12), -r[0]))[0], curve
    data = _assemble(df.withColumn("_fold", F.col(fold_col).cast("int")), label, cols, "_fold").coalesce(1).cache()
    lr = LogisticRegression(elasticNetParam=1.0, standardization=True, maxIter=50, tol=1e-5)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(lambdas)).build()
    ev = MulticlassClassificationEvaluator(metricName="accuracy")
    model = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=ev, foldCol="_fold", numFolds=k,
                           parallelism=8).fit(data)
    data.unpersist()
    curve = [(float(lam), 1.0 - float(m), float(s) / math.sqrt(k - 1))  # stdMetrics divides by k, a standard error by k - 1
             for lam, m, s in zip(lambdas, model.avgMetrics, model.stdMetrics)]
    return min(curve, key=lambda r: (round(r[1], 12), -r[0]))[0], curve


def cv_curve(errors: DataFrame) -> DataFrame:
    """O116: ``(lambda, fold, error)`` → mean error and its standard error per λ."""
    return errors.groupBy("lambda").agg(F.avg("error").alias("cv_error"),
                                        (F.stddev_samp("error") / F.sqrt(F.count("*"))).alias("cv_se"))


def lambda_max(df: DataFrame, label: str, cols: list[str]) -> float:
    """Smallest λ giving an all-zero LASSO logit on standardised regressors:
    max_j |Σ x_j (y − ȳ)| / (n · sd_j) — one aggregate."""
    y = F.col(label).cast("double")
    aggs = [F.avg(y).alias("ybar"), F.count("*").alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.sum(F.col(f"`{c}`") * y).alias(f"sxy{i}"), F.sum(F.col(f"`{c}`")).alias(f"sx{i}"),
                 F.stddev_samp(F.col(f"`{c}`")).alias(f"sd{i}")]
    r = df.agg(*aggs).first()
    best = 0.0
    for i in range(len(cols)):
        sd = r[f"sd{i}"] or 0.0
        if sd > 0:
            g = abs(r[f"sxy{i}"] - r["ybar"] * r[f"sx{i}"]) / (r["n"] * sd)
            best = max(best, g)
    return best


def sparse_fit(df: DataFrame, label: str, cols: list[str], reg: float, max_iter: int = 100, tol: float = 1e-10):
    """O117: LASSO logit at one λ."""
    data = _assemble(df, label, cols)
    return LogisticRegression(elasticNetParam=1.0, regParam=reg, standardization=True, maxIter=max_iter,
                              tol=tol).fit(data)


def timeslice_cv(df: DataFrame, label: str, cols: list[str], lambdas: list[float], train: int = 60,
                 test: int = 10, order_col: str = "date", cells: int = SENT_CELLS) -> list[tuple[float, int, float | None, str | None]]:
    """O114: rolling-origin CV.  Rows get a period index; slice s trains on
    [s, s+train) and tests on [s+train, s+train+test).  The slices' whole paths
    are fitted in one job while the table has at most ``cells`` cells, else one
    fit per slice and λ.  Returns ``(lambda, slice, error, reason)``: a slice
    whose training rows have one class has no fit, so a NULL error and the reason."""
    # periods are ranked by their distinct dates: one row per period
    dates = df.select(order_col).distinct().withColumn("_t", F.row_number().over(Window.orderBy(order_col)) - 1)
    ranked = df.join(dates, order_col)
    if table := _sent(ranked, label, cols, "_t", cells=cells):
        x, y, (at,) = table
        slices = list(range(max(0, int(at.max(initial=-1)) + 2 - train - test)))
        split = lambda s: ((at >= s) & (at < s + train), (at >= s + train) & (at < s + train + test))
        found = _grid_errors(df.sparkSession, x, y, slices, split, lambdas)
        return [(float(lambdas[i]), s, e, "one class in training" if e is None else None) for s, i, e in found]
    data = _assemble(ranked, label, cols, "_t").coalesce(1).cache()
    n = (data.select(F.max("_t")).first()[0] or 0) + 1
    lr = LogisticRegression(elasticNetParam=1.0, standardization=True, maxIter=50, tol=1e-5)
    out = []
    for s in range(0, max(0, n - train - test + 1)):
        tr = data.where((F.col("_t") >= s) & (F.col("_t") < s + train)).cache()
        te = data.where((F.col("_t") >= s + train) & (F.col("_t") < s + train + test))
        if tr.select("label").distinct().count() < 2:
            out += [(float(lam), s, None, "one class in training") for lam in lambdas]
        else:
            for lam, m in lr.fitMultiple(tr, [{lr.regParam: x} for x in lambdas]):
                err = m.transform(te).select(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]
                out.append((float(lambdas[lam]), s, float(err), None))
        tr.unpersist()
    data.unpersist()
    return out


def best_lambda(errors: list[tuple]) -> float | None:
    """λ of least mean error over slices that have one; ties to the larger λ."""
    means: dict[float, list[float]] = {}
    for lam, _, err, *_ in errors:
        if err is not None:
            means.setdefault(lam, []).append(err)
    return min(means, key=lambda x: (round(sum(means[x]) / len(means[x]), 12), -x)) if means else None
