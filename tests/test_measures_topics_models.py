"""Measures, DTM statistics, topics, models and attribution on small frames."""

import datetime as dt
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentimetry.functions import weights as W
from sentimetry.operators import attribution as A
from sentimetry.operators import dtm as D
from sentimetry.operators import lda as LDA
from sentimetry.operators import measures as M
from sentimetry.operators import models as MD
from sentimetry.operators import target as TG
from sentimetry.operators import topics as TP


def d(s):
    return dt.date.fromisoformat(s)


# --- weights -------------------------------------------------------------------
def test_weight_values_by_hand():
    assert W.exponential_weights(3, 0.5) == pytest.approx([1 / 7, 2 / 7, 4 / 7])
    # lag 2, R = 2, r = 1: x = .5: .5 * .5 = .25; x = 1: 1 * 0 = 0
    assert W.almon_weights(2, 1, 2) == pytest.approx([1.0, 0.0])
    # inverse: x = .5: .25; x = 0: 0;  r = 2: x = .5: .75; x = 1: 1
    assert W.almon_weights(2, 2, 2) == pytest.approx([0.75 / 1.75, 1 / 1.75])


@pytest.mark.parametrize("how", ["equal_weight", "linear", "exponential", "almon"])
def test_weights_sum_to_one(how):
    for name, w in W.time_schemes((how,), 7, alphas_exp=(0.2, 0.5)).items():
        assert sum(w) == pytest.approx(1.0), name
        assert len(w) == 7


def test_linear_and_exponential_newest_heaviest():
    assert W.linear_weights(4) == pytest.approx([0.1, 0.2, 0.3, 0.4])
    e = W.exponential_weights(5, 0.3)
    assert all(a < b for a, b in zip(e, e[1:]))


def test_weight_validation():
    with pytest.raises(ValueError):
        W.exponential_weights(3, 1.5)
    with pytest.raises(ValueError):
        W.almon_weights(1, 1, 3)  # all-zero set
    with pytest.raises(ValueError):
        M.AggOptions(fill="sideways")
    with pytest.raises(ValueError):
        M.AggOptions(lag=0)


# --- document aggregation, fill, roll --------------------------------------------
def _doc_sent(spark, rows):
    return spark.createDataFrame(rows, "id long, date date, word_count long, lexicon string, feature string, "
                                       "score double")


def test_aggregate_documents_two_docs_one_date(spark):
    ds = _doc_sent(spark, [(1, d("2020-01-01"), 10, "L", "f", 1.0), (2, d("2020-01-01"), 30, "L", "f", 0.0),
                           (3, d("2020-01-01"), 30, "L", "f", 3.0)])
    eq = M.aggregate_documents(ds, "day", "equal_weight", True).first()["value"]
    eqz = M.aggregate_documents(ds, "day", "equal_weight", False).first()["value"]
    pr = M.aggregate_documents(ds, "day", "proportional", True).first()["value"]
    assert eq == pytest.approx(2.0)
    assert eqz == pytest.approx(4.0 / 3)
    assert pr == pytest.approx((10 * 1 + 30 * 3) / 40.0)
    allzero = _doc_sent(spark, [(1, d("2020-01-01"), 5, "L", "f", 0.0)])
    assert M.aggregate_documents(allzero, "day").first()["value"] == 0.0


def _series(spark):
    return spark.createDataFrame([(d("2020-01-01"), "L", "f", 1.0), (d("2020-01-05"), "L", "f", 2.0)],
                                 "date date, lexicon string, feature string, value double")


def test_fill_zero_and_latest(spark):
    z = [(r["date"], r["value"]) for r in M.fill_periods(_series(spark), "day", "zero").orderBy("date").collect()]
    assert z == [(d("2020-01-01"), 1.0), (d("2020-01-02"), 0.0), (d("2020-01-03"), 0.0), (d("2020-01-04"), 0.0),
                 (d("2020-01-05"), 2.0)]
    lt = [r["value"] for r in M.fill_periods(_series(spark), "day", "latest").orderBy("date").collect()]
    assert lt == [1.0, 1.0, 1.0, 1.0, 2.0]
    m = spark.createDataFrame([(d("2020-01-01"), "L", "f", 1.0), (d("2020-04-01"), "L", "f", 2.0)],
                              "date date, lexicon string, feature string, value double")
    assert M.fill_periods(m, "month", "zero").count() == 4


def test_roll_linear_and_short_series(spark):
    s = spark.createDataFrame([(d(f"2020-01-0{i}"), "L", "f", float(i)) for i in (1, 2, 3)],
                              "date date, lexicon string, feature string, value double")
    out = [r["value"] for r in M.roll_series(s, {"linear": W.linear_weights(2)}).orderBy("date").collect()]
    assert out == pytest.approx([5 / 3, 8 / 3])
    assert M.roll_series(s, {"equal_weight": W.equal_weights(5)}).count() == 0


def _measures(spark):
    rows = []
    for i, day in enumerate(["2020-01-01", "2020-01-02"]):
        for lx, f, v in [("A", "x", 1.0 + i), ("A", "y", 3.0), ("B", "x", -1.0), ("B", "y", 0.5)]:
            rows.append((d(day), lx, f, "equal_weight", v))
    return spark.createDataFrame(rows, "date date, lexicon string, feature string, time string, value double")


def test_merge_global_select_scale(spark):
    m = _measures(spark)
    merged = M.merge_measures(m, features={"all": ["x", "y"]})
    got = {(r["date"], r["lexicon"]): r["value"] for r in merged.collect()}
    assert got[(d("2020-01-01"), "A")] == pytest.approx(2.0)
    assert merged.select("feature").distinct().count() == 1
    g = {r["date"]: r["global"] for r in M.global_index(m, lexicons={"A": 3.0, "B": 1.0}).collect()}
    assert g[d("2020-01-01")] == pytest.approx((3 * (1 + 3) + (-1 + 0.5)) / 8)
    assert M.select_measures(m, ["A", "y"], do_combine=False).count() == 2
    assert M.select_measures(m, ["A", "y"], do_combine=True).count() == 6
    sc = M.scale_measures(m).where("lexicon = 'B'").collect()
    assert all(r["value"] is None for r in sc)  # constant measure: sd 0
    sp = M.spread_index(spark.createDataFrame([("c1", d("2020-01-01"), 1.0), ("c2", d("2020-01-01"), 0.25)],
                                              "cluster string, date date, global double")).first()
    assert (sp["c1"], sp["c2"], sp["spread"]) == ("c1", "c2", 0.75)


def test_fill_takes_one_grid_for_all_series(spark):
    rows = [(d("2020-01-01"), "A", "x", 1.0), (d("2020-04-01"), "A", "x", 4.0), (d("2020-02-01"), "B", "x", 2.0)]
    s = spark.createDataFrame(rows, "date date, lexicon string, feature string, value double")
    zero = {(r["lexicon"], r["date"].month): r["value"] for r in M.fill_periods(s, "month", "zero").collect()}
    assert zero == {("A", 1): 1, ("A", 2): 0, ("A", 3): 0, ("A", 4): 4, ("B", 1): 0, ("B", 2): 2, ("B", 3): 0, ("B", 4): 0}
    last = {(r["lexicon"], r["date"].month): r["value"] for r in M.fill_periods(s, "month", "latest").collect()}
    assert last == {("A", 1): 1, ("A", 2): 1, ("A", 3): 1, ("A", 4): 4, ("B", 2): 2, ("B", 3): 2, ("B", 4): 2}
    dates = M.measure_dates(s.select("date"), M.AggOptions(by="month", lag=2, fill="zero"))
    assert sorted(r["date"].month for r in dates.collect()) == [2, 3, 4]


def test_measures_stats_pairs(spark):
    st = {r["measure"]: r for r in M.measures_stats(_measures(spark)).collect()}
    assert st["A--x--equal_weight"]["mean"] == pytest.approx(1.5)
    assert len(st) == 4


# --- DTM -------------------------------------------------------------------------
def _dtm(spark):
    return spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "c", 1)], "id long, term string, n long")


def test_tfidf_and_term_scores(spark):
    t = {(r["id"], r["term"]): r["tfidf"] for r in D.tfidf_docs(_dtm(spark)).collect()}
    assert t[(1, "a")] == pytest.approx(1 / 3 * math.log10(2))
    assert t[(1, "b")] == pytest.approx(0.0)
    s = {r["term"]: r["score"] for r in D.term_tfidf_mean(_dtm(spark)).collect()}
    assert s["a"] == pytest.approx(1 / 3 * math.log2(2))
    assert s["b"] == pytest.approx(0.0)
    assert {r["term"] for r in D.prune_by_tfidf(_dtm(spark), 0.2).collect()} == {"a", "c"}
    assert {r["term"] for r in D.prune_sparse_terms(_dtm(spark), 0.4).collect()} == {"b"}


def test_six_number_summary_type7(spark):
    x = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    r = D.six_number_summary(df, "v").first()
    q = np.percentile(x, [25, 50, 75])
    assert (r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (1.0, q[0], q[1], q[2], 10.0)
    assert r["mean"] == pytest.approx(4.0)


@pytest.mark.parametrize("n", [1, 2, 7, 1000, 20000])
def test_exact_quantiles(spark, n):
    rng = np.random.default_rng(n)
    x = rng.choice([0.0, 1.0, 2.5], n) + rng.normal(size=n) * (rng.random(n) < 0.7)  # with ties
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(5)
    ps = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert D.exact_quantiles(df, "v", ps) == pytest.approx(list(np.quantile(x, ps)))
    assert D.exact_quantiles(df.where("false"), "v", [0.5]) == [None]


def test_documents_without_terms_count(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    n = D.n_documents(docs)
    t = {(r["id"], r["term"]): r["tfidf"] for r in D.tfidf_docs(_dtm(spark), n).collect()}
    assert t[(1, "a")] == pytest.approx(1 / 3 * math.log10(3)) and t[(2, "b")] == pytest.approx(0.5 * math.log10(1.5))
    assert {r["id"]: r["doc_len"] for r in D.doc_lengths(_dtm(spark), docs).collect()} == {1: 3, 2: 2, 3: 0}


def test_one_scan_and_one_tokenisation(spark):
    """The statistics' plans read the text once."""
    corpus = spark.createDataFrame([(1, "aaa bbb ccc"), (2, "aaa ddd")], "id long, text string")
    plan = D.term_tfidf_mean(D.topic_dtm(corpus, ["bbb"], 3, True), F.lit(2))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Generate ") == 1 and "Join" not in text
    got = {r["term"]: r["score"] for r in plan.collect()}
    assert got == {"aaa": 0.0, "ccc": pytest.approx(0.5), "ddd": pytest.approx(0.5)}


def test_dtm_slice_dense(spark):
    out = D.dtm_slice(_dtm(spark), 2, 3)
    assert out.count() == 6
    assert {(r["id"], r["term"]): r["n"] for r in out.collect()}[(2, "a")] == 0


# --- topics ------------------------------------------------------------------------
def test_topic_tables(spark):
    theta = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.2), (2, 2, 0.8)],
                                  "doc_id long, topic int, theta double")
    tod = {r["doc_id"]: r["topic"] for r in TP.topic_of_doc(theta).collect()}
    assert tod == {1: 1, 2: 2}  # tie goes to the lower topic
    for r in theta.groupBy("doc_id").agg(F.sum("theta").alias("s")).collect():
        assert r["s"] == pytest.approx(1.0)
    phi = spark.createDataFrame([("t1", "a", 0.5), ("t1", "b", 0.5), ("t2", "a", 0.5), ("t2", "b", 0.5),
                                 ("t3", "a", 0.9), ("t3", "b", 0.1)], "topic string, term string, phi double")
    jsd = {(r["t1"], r["t2"]): r["jsd"] for r in TP.topic_distance(phi).collect()}
    assert jsd[("t1", "t2")] == pytest.approx(0.0)
    assert jsd[("t1", "t3")] > 0
    lab = {r["topic"]: r["label"] for r in TP.topic_label(TP.topic_top_terms(phi, 2), 2).collect()}
    assert lab["t3"] == "a b"
    cat = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, category string")
    tbc = TP.theta_by_category(theta, cat)
    ratio = {(r["category"], r["topic"]): r for r in TP.topic_diagnostic_ratio(tbc).collect()}
    assert ratio[("y", 2)]["ratio"] == pytest.approx(4.0) and ratio[("y", 2)]["rank"] == 1


def _lda_table(spark):
    return spark.createDataFrame([(i, t, 1 + (i + j) % 3) for i in range(12) for j, t in enumerate("abcdef")
                                  if (i + j) % 2 == 0], "id long, term string, n long")


def test_lda_shares_and_rising_bound(spark):
    docs = spark.range(14)  # two documents without a term
    m = LDA.lda_em(_lda_table(spark), docs, [2, 3], seed=1, tol=1e-5)
    for model, k in ((0, 2), (1, 3)):
        th = m.theta_long(model).groupBy("doc_id").agg(F.sum("theta").alias("s"), F.count("*").alias("n")).collect()
        assert len(th) == 14 and all(r["s"] == pytest.approx(1.0) and r["n"] == k for r in th)
        ph = m.phi_long(model).groupBy("topic").agg(F.sum("phi").alias("s"), F.count("*").alias("n")).collect()
        assert len(ph) == k and all(r["s"] == pytest.approx(1.0) and r["n"] == 6 for r in ph)
        assert all(y >= x - 1e-9 for x, y in zip(m.trace[model], m.trace[model][1:]))
    assert m.theta_long(0).where("doc_id = 13").select("theta").collect() == [(0.5,), (0.5,)]


def test_lda_one_exact_step(spark):
    """One E-step and one M-step by hand: a = 0.5, b = 0.25, two topics."""
    rows = [(1, "x", 2), (1, "y", 1), (2, "y", 3), (2, "z", 1)]
    share = {(1, "x"): 0.75, (1, "y"): 0.5, (2, "y"): 0.25, (2, "z"): 0.1}
    dtm = spark.createDataFrame(rows, "id long, term string, n long")
    start = spark.createDataFrame([(i, t, n * share[i, t], n * (1 - share[i, t])) for i, t, n in rows],
                                  "id long, term string, g0_0 double, g0_1 double")
    m = LDA.lda_em(dtm, spark.createDataFrame([(1,), (2,)], "id long"), [2], doc_prior=0.5, term_prior=0.25,
                   start=start, rounds=1)

    def parameters(g):
        nd, nt, nk = {}, {}, [0.0, 0.0]
        for (i, t), v in g.items():
            for k in (0, 1):
                nd.setdefault(i, [0, 0])[k] += v[k]
                nt.setdefault(t, [0, 0])[k] += v[k]
                nk[k] += v[k]
        theta = {i: [(v[k] + 0.5) / (sum(v) + 1.0) for k in (0, 1)] for i, v in nd.items()}
        phi = {t: [(v[k] + 0.25) / (nk[k] + 3 * 0.25) for k in (0, 1)] for t, v in nt.items()}
        return theta, phi

    g = {(i, t): [n * share[i, t], n * (1 - share[i, t])] for i, t, n in rows}
    theta, phi = parameters(g)
    g = {}
    for i, t, n in rows:
        w = [theta[i][k] * phi[t][k] for k in (0, 1)]
        g[i, t] = [n * x / sum(w) for x in w]
    theta, phi = parameters(g)
    got = {(r["doc_id"], r["topic"]): r["theta"] for r in m.theta_long().collect()}
    assert got == {(i, k + 1): pytest.approx(theta[i][k]) for i in theta for k in (0, 1)}
    got = {(r["term"], r["topic"]): r["phi"] for r in m.phi_long().collect()}
    assert got == {(t, k + 1): pytest.approx(phi[t][k]) for t in phi for k in (0, 1)}


def test_topic_model_removals(spark):
    for remove in ("no", "sparse", "tf-idf"):
        out = TP.topic_model(_lda_table(spark), spark.range(12), remove, p=0.6, k=2, t=3, tol=1e-2)
        assert out["topics"].count() == 12 and out["terms"].groupBy("topic").count().where("count > 3").isEmpty()
    with pytest.raises(ValueError):
        TP.topic_model(_lda_table(spark), spark.range(12), "other")


def test_metric_values(spark):
    """O97 divides the pair sum by k(k−1); O98 compares singular values with
    length-weighted totals as they are."""
    phi = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.8), (2, "b", 0.2)],
                                "topic int, term string, phi double")
    kl = 0.5 * (0.5 * math.log(0.5 / 0.8) + 0.5 * math.log(0.5 / 0.2)) + 0.5 * (
        0.8 * math.log(0.8 / 0.5) + 0.2 * math.log(0.2 / 0.5))
    assert TP.metric_deveaud(phi).first()["value"] == pytest.approx(kl / 2)
    theta = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 0.2), (2, 2, 0.8)],
                                  "doc_id long, topic int, theta double")
    lens = spark.createDataFrame([(1, 4), (2, 10)], "id long, doc_len long")
    c1 = np.linalg.svd(np.array([[0.5, 0.5], [0.8, 0.2]]), compute_uv=False)
    c2 = np.array([4 * 0.5 + 10 * 0.2, 4 * 0.5 + 10 * 0.8]) / 10
    want = (c1 * np.log(c1 / c2)).sum() + (c2 * np.log(c2 / c1)).sum()
    assert TP.metric_arun(phi, theta, lens) == pytest.approx(want)


def test_token_table(spark):
    phi = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.25)], "topic int, term string, phi double")
    share = spark.createDataFrame([(1, 0.4), (2, 0.6)], "topic int, share double")
    got = {r["topic"]: r["freq"] for r in TP.topic_token_table(phi, share).collect()}
    assert got == {1: pytest.approx(0.2 / 0.35), 2: pytest.approx(0.15 / 0.35)}


# --- target, models, attribution ----------------------------------------------------
def test_targets(spark):
    s = spark.createDataFrame([(d(f"2020-0{i}-01"), float(v)) for i, v in enumerate([5, -9, 9, 1], start=1)],
                              "date date, volume double")
    lab = {r["date"].month: r["label"] for r in TG.top_abs_events(s, 2).collect()}
    assert lab == {1: 0, 2: 1, 3: 1, 4: 0}  # |-9| = |9|: both kept, earlier first
    with pytest.raises(ValueError):
        TG.timeline_target(s, None)


def test_saturated_logit_closed_form(spark):
    rows = [(1, 0.0)] * 30 + [(0, 0.0)] * 10 + [(1, 1.0)] * 5 + [(0, 1.0)] * 15
    df = spark.createDataFrame(rows, "label int, x1 double")
    m = MD.logit_fit(df, "label", ["x1"])
    assert m.intercept == pytest.approx(math.log(3.0), abs=1e-8)
    assert m.coefficients[0] == pytest.approx(math.log(1 / 3) - math.log(3.0), abs=1e-8)
    c = {r["term"]: r for r in MD.coef_table(spark, m, ["x1"]).collect()}
    assert c["x1"]["std_error"] == pytest.approx(math.sqrt(1 / 30 + 1 / 10 + 1 / 5 + 1 / 15), abs=1e-6)
    n = MD.logit_null(df, "label").first()
    assert n["estimate"] == pytest.approx(math.log(35 / 25))
    trace = MD.stepwise_aic(df.withColumn("x2", F.rand(seed=3)), "label", ["x1", "x2"])
    aics = [t[3] for t in trace]
    assert all(b <= a + 1e-9 for a, b in zip(aics, aics[1:]))


def test_sparse_at_lambda_max_is_intercept_only(spark):
    rows = [(1, float(i % 3), float(i % 5)) for i in range(40)] + [(0, float(i % 4), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    lam = MD.lambda_max(df, "label", ["a", "b"])
    m = MD.sparse_fit(df, "label", ["a", "b"], lam * 1.01)
    assert list(m.coefficients) == [0.0, 0.0]
    assert m.intercept == pytest.approx(math.log(40 / 20), abs=1e-6)


def test_lasso_of_one_binary_regressor_closed_form(spark):
    """O117 with a non-zero coefficient: at the optimum the mean residual
    covariance of the standardised regressor equals λ in absolute value."""
    rows = [(1, 0.0)] * 30 + [(0, 0.0)] * 10 + [(1, 1.0)] * 5 + [(0, 1.0)] * 15
    df = spark.createDataFrame(rows, "label int, x1 double")
    lam = MD.lambda_max(df, "label", ["x1"]) / 3
    m = MD.sparse_fit(df, "label", ["x1"], lam)
    b0, b = m.intercept, m.coefficients[0]
    p = lambda x: 1 / (1 + math.exp(-(b0 + b * x)))
    assert sum(y - p(x) for y, x in rows) / len(rows) == pytest.approx(0, abs=1e-5)
    sd = np.std([x for _, x in rows], ddof=1)
    slope = sum((y - p(x)) * x for y, x in rows) / len(rows) / sd
    assert b < 0 and slope == pytest.approx(-lam, abs=1e-5)


def test_kfold_choice_and_standard_error(spark):
    rng = np.random.default_rng(0)
    rows = [(int(x + rng.normal() > 0), float(x), float(rng.normal()), i % 5) for i, x in enumerate(rng.normal(size=60))]
    df = spark.createDataFrame(rows, "label int, a double, b double, fold int")
    path = MD.lambda_path(df, "label", ["a", "b"], 4)
    assert path[0] == pytest.approx(MD.lambda_max(df, "label", ["a", "b"])) and path[-1] == pytest.approx(path[0] * 0.01)
    best, curve = MD.lasso_kfold(df, "label", ["a", "b"], path, k=5)
    assert best == min(curve, key=lambda r: (round(r[1], 12), -r[0]))[0]
    assert MD.sparse_fit(df, "label", ["a", "b"], best).getRegParam() == best
    errors = []
    for lam in path:
        for f in range(5):
            m = MD.sparse_fit(df.where(f"fold <> {f}"), "label", ["a", "b"], lam, 50, 1e-5)
            t = m.transform(MD._assemble(df.where(f"fold = {f}"), "label", ["a", "b"]))
            errors.append((lam, f, t.select(F.avg((F.col("prediction") != F.col("label")).cast("double"))).first()[0]))
    want = MD.cv_curve(spark.createDataFrame(errors, "lambda double, fold int, error double")).collect()
    assert {r["lambda"]: (r["cv_error"], r["cv_se"]) for r in want} == {
        x: (pytest.approx(e, abs=1e-9), pytest.approx(se, abs=1e-9)) for x, e, se in curve}


def test_timeslices_keep_one_class_slices(spark):
    rows = [(d(f"20{i:02d}-01-01"), int(i >= 8 and i % 2), float(i % 3)) for i in range(14)]
    df = spark.createDataFrame(rows, "date date, label int, a double")
    out = MD.timeslice_cv(df, "label", ["a"], [0.1, 0.01], 6, 2)
    assert sorted({r[1] for r in out}) == list(range(7))
    assert [(r[2], r[3]) for r in out if r[1] == 0] == [(None, "one class in training")] * 2
    assert all(r[2] is not None and r[3] is None for r in out if r[1] == 6)
    assert MD.best_lambda(out) in (0.1, 0.01)


def test_stepwise_raises_what_is_no_singular_fit(spark, monkeypatch):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(10)], "label int, x1 double")

    def lost(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(MD.GeneralizedLinearRegression, "fit", lost)
    with pytest.raises(RuntimeError):
        MD.stepwise_aic(df, "label", ["x1"])


def test_attribution_sums_to_link(spark):
    m = _measures(spark)
    coefs = spark.createDataFrame([("A--x--equal_weight", 2.0), ("B--y--equal_weight", -1.0)],
                                  "measure string, beta double")
    link = A.predict_link(m, coefs, 0.5)
    chk = A.attribution_check(link, A.attribution(m, coefs, "lexicon"), 0.5).collect()
    assert all(abs(r["residual"]) < 1e-9 for r in chk)
    l1 = {r["date"]: r["link"] for r in link.collect()}
    assert l1[d("2020-01-01")] == pytest.approx(0.5 + 2.0 - 0.5)
    pred = A.predict_class(link)
    tgt = pred.select("date", (1 - F.col("pred")).alias("label"))
    cs = A.confusion_scores(pred, tgt).first()
    assert cs["TP"] + cs["TN"] + cs["FP"] + cs["FN"] == 2 and cs["accuracy"] == 0.0
    allg = A.attribution_all_dims(m, coefs)
    assert allg.where("dim = 'feature'").count() == 4


def test_sink_round_trip(spark):
    from sentimetry.sources.sinks import write_and_read
    df = _measures(spark)
    back = write_and_read(spark, df, "t", partition_by=["lexicon"])
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_lda_by_document_equals_joins(spark):
    """The map with φ sent to the tasks and the joins give the same rounds."""
    docs = spark.range(14)
    one, two = (LDA.lda_em(_lda_table(spark), docs, [2, 3], seed=5, rounds=6, tol=0, broadcast_cells=c) for c in (10**6, 0))
    for x, y in zip(one.trace, two.trace):
        assert x == pytest.approx(y) and len(x) == 7
    assert one.log_likelihood == pytest.approx(two.log_likelihood)
    for m in (0, 1):
        theta = [{(r["doc_id"], r["topic"]): r["theta"] for r in t.theta_long(m).collect()} for t in (one, two)]
        phi = [{(r["term"], r["topic"]): r["phi"] for r in t.phi_long(m).collect()} for t in (one, two)]
        assert theta[0] == pytest.approx(theta[1]) and phi[0] == pytest.approx(phi[1])


def test_lda_slices_blocks_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(LDA, "SLICE_CELLS", 8)
    monkeypatch.setattr(LDA, "BLOCK_CELLS", 4)
    docs, table = spark.range(14), _lda_table(spark)
    small = LDA.lda_em(table, docs, [3], seed=5, rounds=3, tol=0)
    monkeypatch.undo()
    assert small.trace[0] == pytest.approx(LDA.lda_em(table, docs, [3], seed=5, rounds=3, tol=0).trace[0])
    empty = LDA.lda_em(table.limit(0), docs, [2], seed=5)
    assert empty.phi.count() == 0 and {tuple(r["shares"]) for r in empty.theta.collect()} == {(0.5, 0.5)}
    named = LDA.lda_em(table.withColumn("id", F.concat(F.lit("d"), "id")), spark.createDataFrame([("d1",)], "id string"), [2], seed=5, rounds=1)
    assert named.theta_long().count() == 2


def test_draws_are_sparks_hash(spark):
    import numpy as np
    h = np.array([0, 1, -5, 2**62], np.int64)
    got = LDA._xxhash64(np.full(4, 3, np.uint64), h.view(np.uint64)).view(np.int64).tolist()
    rows = [r[0] for r in spark.range(5).select(F.xxhash64("id", F.lit(3).cast("long"))).collect()]
    first = np.array([r[0] for r in spark.range(5).select(F.xxhash64("id")).collect()], np.int64)
    assert LDA._xxhash64(np.full(5, 3, np.uint64), first.view(np.uint64)).view(np.int64).tolist() == rows
    assert len(set(got)) == 4


def test_pair_sums_against_numpy(spark):
    """Metrics of two models side by side, from one pass, against plain formulas."""
    import numpy as np
    rng = np.random.default_rng(1)
    ks = [2, 3]
    p = rng.dirichlet(np.ones(40), 5)
    p[1, 3] = p[4, 7] = 0.0
    terms = spark.createDataFrame([(f"t{j}", p[:, j].tolist()) for j in range(40)], "term string, shares array<double>").repartition(3)
    ln = lambda v: np.log(np.where(v > 0, v, 1.0))
    at = 0
    for k, sums in zip(ks, TP.pair_sums(terms, ks)):
        own = p[at:at + k]
        at += k
        cos = own @ own.T / np.outer(*[np.sqrt((own ** 2).sum(1))] * 2)
        assert TP.cao_juan(sums) == pytest.approx(cos[np.triu_indices(k, 1)].mean())
        jsd = [[sum((x * ln(x)).sum() / 2 for x in (own[i], own[j])) - ((own[i] + own[j]) / 2 * ln((own[i] + own[j]) / 2)).sum() for j in range(k)] for i in range(k)]
        assert np.allclose(sums.distances(), jsd)
        sym = [((own[i] - own[j]) * (ln(own[i]) - ln(own[j]))).sum() / 2 for j in range(k) for i in range(j)]
        assert TP.deveaud(sums) == pytest.approx(np.mean(sym) / 2)


def test_scores_of_fitted_models_against_numpy(spark):
    import numpy as np
    table, docs = _lda_table(spark), spark.range(14)
    lens = table.groupBy("id").agg(F.sum("n").alias("doc_len"))
    m = LDA.lda_em(table, docs, [2, 3], seed=2, rounds=3, tol=0)
    got = {(r["k"], r["metric"]): r["value"] for r in TP.score_models(spark, m, lens).collect()}
    n = {(r["id"], r["term"]): r["n"] for r in table.collect()}
    for i, k in enumerate((2, 3)):
        theta = {(r["doc_id"], r["topic"]): r["theta"] for r in m.theta_long(i).collect()}
        phi = {(r["term"], r["topic"]): r["phi"] for r in m.phi_long(i).collect()}
        like = sum(c * np.log(sum(theta[d, t] * phi[w, t] for t in range(1, k + 1))) for (d, w), c in n.items())
        assert got[k, "griffiths_bound"] == pytest.approx(like)
        assert TP.log_likelihood(table, m.theta_long(i), m.phi_long(i)).first()[0] == pytest.approx(like)
        assert got[k, "Arun2010"] == pytest.approx(TP.metric_arun(m.phi_long(i), m.theta_long(i), lens))
        assert got[k, "CaoJuan2009"] == pytest.approx(TP.metric_cao_juan(m.phi_long(i)).first()[0])
        assert got[k, "Deveaud2014"] == pytest.approx(TP.metric_deveaud(m.phi_long(i)).first()[0])


def test_lasso_path_equals_single_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * [1, 5, 0.2, 1]
    x[:, 3] = 2.0  # constant
    y = (x[:, 0] - 0.4 * x[:, 1] + rng.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(int(c), *map(float, r)) for c, r in zip(y, x)], "label int, a double, b double, c double, k double")
    path = MD.lambda_path(df, "label", list("abc"), 4)
    b = MD.lasso_path(x, y.astype(float), path)
    for i, lam in enumerate(path):
        m = MD.sparse_fit(df, "label", list("abck"), lam)
        assert b[:, i] == pytest.approx([m.intercept, *m.coefficients], abs=2e-4)


def test_grids_equal_fits_one_by_one(spark):
    """The one-job grid and MLlib's fits, which a larger table gets, agree."""
    rng = np.random.default_rng(5)
    rows = [(d(f"20{i // 4:02d}-0{1 + i % 4}-01"), int(v + rng.normal() > 0), float(v), float(rng.normal()), i % 3) for i, v in enumerate(rng.normal(size=48))]
    df = spark.createDataFrame(rows, "date date, label int, a double, b double, fold int")
    path = MD.lambda_path(df, "label", ["a", "b"], 3)
    (x, one), (z, two) = (MD.lasso_kfold(df, "label", ["a", "b"], path, 3, cells=c) for c in (10**6, 0))
    assert x == z and np.allclose(one, two)
    got, want = (sorted(MD.timeslice_cv(df, "label", ["a", "b"], path, 40, 4, cells=c)) for c in (10**6, 0))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])


def test_stepwise_in_one_job_a_step_equals_single_fits(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a + rng.normal() > 0), float(a), float(rng.normal()), float(2 * a)) for a in rng.normal(size=60)]
    df = spark.createDataFrame(rows, "label int, a double, b double, twice double")
    one, two = (MD.stepwise_aic(df, "label", ["a", "b"], ["a", "b", "a:b"], cells=c) for c in (10**6, 0))
    assert [r[:3] for r in one] == [r[:3] for r in two] and [r[3] for r in one] == pytest.approx([r[3] for r in two], abs=1e-5)
    x, y = np.array([r[1:] for r in rows]), np.array([float(r[0]) for r in rows])
    assert MD._aic(x, y) == math.inf and MD._aic(np.sign(y - 0.5)[:, None], y) == math.inf


def test_mean_correlation_with_gaps_and_constants(spark):
    import pandas as pd
    rng = np.random.default_rng(2)
    dates = pd.date_range("2020-01-01", periods=30)
    wide = pd.DataFrame({"a": rng.normal(size=30), "b": 1e6 + rng.normal(size=30), "c": 5.0, "d": rng.normal(size=30)}, index=dates)
    wide["b"] += wide["a"]
    wide.loc[dates[:12], "d"] = np.nan
    rows = [(t.date(), k, "f", "w", float(v)) for k in wide for t, v in wide[k].items() if not np.isnan(v)]
    df = spark.createDataFrame(rows, "date date, lexicon string, feature string, time string, value double").repartition(3)
    got = {r["measure"][0]: r["meanCorr"] for r in M.measures_stats(df).collect()}
    r = wide.corr()
    for k in "abd":
        assert got[k] == pytest.approx(r.loc[k, [x for x in "abd" if x != k]].mean(), abs=1e-9)
    assert got["c"] is None
    assert M.measures_stats(df.limit(0)).count() == 0


def test_fill_keeps_series_in_their_partitions(spark, tmp_path):
    docs = spark.createDataFrame([(d("2019-12-30"),), (d("2020-01-07"),)], "date date")
    filled = M.fill_periods(_series(spark), "day", "zero", ends=M.period_ends(docs, "day"))
    assert filled.count() == 9 and filled.agg(F.sum("value")).first()[0] == 3.0
    for df in (filled, M.fill_periods(_series(spark), "day", "latest")):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        for line, below in zip(plan, plan[1:]):  # one row only: a total of partial totals
            assert "SinglePartition" not in line or "partial_" in below


def test_lda_groups_and_single_precision_equal_joins(spark, monkeypatch):
    """Models too large together take turns; φ beyond the bound in doubles is sent in single precision."""
    docs, table = spark.range(14), _lda_table(spark)
    assert LDA._groups([2, 3, 4], 6, 30) == [[0, 1], [2]] and LDA._groups([2, 3], 6, 18) == [[0], [1]]
    two = LDA.lda_em(table, docs, [2, 3], seed=5, rounds=6, tol=0, broadcast_cells=0)
    monkeypatch.setattr(LDA, "_by_rows", None)  # terms x topics of both are over 18, of each are not
    monkeypatch.setattr(LDA, "DOUBLE_CELLS", 12)
    one = LDA.lda_em(table, docs, [2, 3], seed=5, rounds=6, tol=0, broadcast_cells=18)
    for x, y in zip(one.trace, two.trace):
        assert x == pytest.approx(y) and len(x) == 7
    assert one.log_likelihood == pytest.approx(two.log_likelihood)
    for m in (0, 1):
        theta = [{(r["doc_id"], r["topic"]): r["theta"] for r in t.theta_long(m).collect()} for t in (one, two)]
        phi = [{(r["term"], r["topic"]): r["phi"] for r in t.phi_long(m).collect()} for t in (one, two)]
        assert theta[0] == pytest.approx(theta[1]) and phi[0] == pytest.approx(phi[1], rel=1e-5)


def test_vocabulary_of_the_grid_is_sent():
    """357,521 terms (0.1 GB of documents) and the topics of the grid: no joins."""
    from sentimetry.plans.q_topics import K_GRID
    assert 357_521 * max(K_GRID) <= LDA.BROADCAST_CELLS
    assert all(357_521 * sum(K_GRID[m] for m in g) <= LDA.BROADCAST_CELLS for g in LDA._groups(K_GRID, 357_521, LDA.BROADCAST_CELLS))


def test_lasso_path_in_bounded_memory(monkeypatch):
    """Equal rows count once, different ones come in blocks: no array of rows x λ."""
    import tracemalloc
    rng = np.random.default_rng(4)
    for x in ((rng.random((60_000, 1)) < 0.3).astype(float), rng.normal(size=(6_000, 2))):
        y = (x[:, 0] + rng.normal(size=len(x)) > 0.4).astype(float)
        lam = [0.2 * 0.9**i for i in range(100)]
        monkeypatch.setattr(MD, "BLOCK_CELLS", 20_000)
        tracemalloc.start()
        b = MD.lasso_path(x, y, lam, steps=20)
        errors = MD._misclassified(x, y, b)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < len(x) * len(lam) * 4  # half of one such array
        monkeypatch.setattr(MD, "BLOCK_CELLS", 1 << 40)
        assert np.allclose(b, MD.lasso_path(x, y, lam, steps=20), atol=1e-12)
        assert errors == ((b[0] + x @ b[1:] > 0) != y[:, None]).mean(axis=0).tolist()


def test_lda_rounds_move_shares_and_one_sum_a_core(spark, monkeypatch):
    """A round writes θ and the sums of at most one task a core, not the documents; more partitions than cores give the same rounds."""
    docs, table = spark.range(14), _lda_table(spark)
    two = LDA.lda_em(table, docs, [2, 3], seed=5, rounds=4, tol=0, broadcast_cells=0)
    monkeypatch.setattr(LDA, "TASK_CELLS", 1)
    monkeypatch.setattr(LDA, "PART_CELLS", 2)
    written, plain = [], LDA.materialize

    def noted(df, name="table", **by):
        out = plain(df, name, **by)
        if name == "lda-state":
            written.append((set(df.columns), out.where("block = -1").count(), out.where("theta IS NOT NULL").count()))
        return out

    monkeypatch.setattr(LDA, "materialize", noted)
    one = LDA.lda_em(table, docs, [2, 3], seed=5, rounds=4, tol=0)
    assert one.trace[0] == pytest.approx(two.trace[0]) and one.trace[1] == pytest.approx(two.trace[1])
    assert len(written) == 6
    for columns, tasks, documents in written:
        assert not columns & {"codes", "counts"} and tasks <= spark.sparkContext.defaultParallelism
        assert documents == table.select("id").distinct().count()


def test_lda_sums_of_repeated_terms():
    """Rows of one term in a slice all count, and a slice's cells are bounded."""
    rng = np.random.default_rng(2)
    totals, plain = LDA._Totals(9, 3, 1, 2), np.zeros((9, 3))
    for _ in range(3):
        codes, shares = rng.integers(0, 7, 50).astype(np.int32), rng.random((50, 3))
        totals.add(codes, shares)
        np.add.at(plain, codes, shares)
    assert np.allclose(totals.term, plain)
    size = np.array([3, 0, 5, 1])
    assert [(r.start, r.stop, c.start, c.stop) for r, c in LDA._slices(size, 1 << 17)] == [(0, 3, 0, 8), (3, 4, 8, 9)]  # 4 cells, and the rest of the last document


def test_lda_blocks_mark_terms_by_a_bit():
    """A block names the terms seen in a bit each, not in four bytes; sums of several tasks add up as they were."""
    rng = np.random.default_rng(3)
    tasks = [LDA._Totals(21, 2, 1, 10) for _ in range(3)]
    for some in tasks:
        some.add(rng.choice(21, 9).astype(np.int32), rng.random((9, 2)))
    tasks[0].term[20] = 0.5, 0.25  # the last block has one term
    sent = [x for some in tasks for x in some.blocks(np.float64)]
    assert all(len(seen) == -(-min(10, 21 - at) // 8) for at, seen, _ in sent if at != LDA.FIT)
    columns = [pa.array(c, t) for c, t in zip(zip(*sent), (pa.int32(), pa.binary(), pa.binary()))]
    added = LDA._added(21, 2, 10, np.float64)(iter([pa.record_batch(columns, names=["block", "seen", "totals"])]))
    out = {b["block"][0].as_py(): np.frombuffer(b["totals"][0].as_py()) for b in added}
    assert np.allclose(np.concatenate([out[at] for at in (0, 10, 20)]), sum(some.term for some in tasks).ravel())


def test_lda_sums_are_added_by_a_task_a_part(spark, tmp_path):
    """Each part's sums in one partition of their own; tables of one partition, put together, would be one."""
    rows = [(b, b"", (np.ones(2) * b).tobytes(), p) for b, p in ((-1, LDA.FIT_PART), (0, 0), (4, 1), (8, 2)) for _ in range(3)]
    spark.createDataFrame(rows, "block int, seen binary, totals binary, part int").repartition(3).write.partitionBy("part").parquet(str(tmp_path / "state"))
    sums = LDA._by_part(spark.read.parquet(str(tmp_path / "state")), 3)
    parts = [{r["block"] for r in part} for part in sums.rdd.glom().collect()]
    assert sorted(b for part in parts for b in part if b >= 0) == [0, 4, 8] and all(len(part) <= 1 for part in parts)
    assert sums.count() == len(rows)


def test_lda_draws_are_bounded_and_as_by_modulus():
    h = np.array([0, 1, -5, 2**62, -(2**63)], np.int64).view(np.uint64)
    for topic in (0, 3):
        whole = LDA._xxhash64(np.full(len(h), topic, np.uint64), h).view(np.int64)
        assert LDA._draw(h, topic).tolist() == (whole % (1 << 20) + 1.0).tolist()


def test_lda_driver_holds_the_phi_of_one_group(spark, monkeypatch):
    """Models that take turns: when one group's φ is sent, no other group's is held, and none of the round before."""
    import weakref
    docs, table = spark.range(14), _lda_table(spark)
    want = LDA.lda_em(table, docs, [2, 3, 4], seed=5, rounds=2, tol=0)
    terms = table.select("term").distinct().count()
    context, sent, held = type(spark.sparkContext), [], []
    plain = context.broadcast

    def noted(self, value):
        sent.append(weakref.ref(value))
        held.append(sum(x() is not None for x in sent))
        return plain(self, value)

    monkeypatch.setattr(context, "broadcast", noted)
    monkeypatch.setattr(LDA, "_by_rows", None)
    got = LDA.lda_em(table, docs, [2, 3, 4], seed=5, rounds=2, tol=0, broadcast_cells=terms * 4)
    assert len(held) == 3 * 4 and set(held) == {1}  # three groups, three rounds and the result
    for x, y in zip(got.trace, want.trace):
        assert x == pytest.approx(y)


def test_lda_groups_stay_under_the_driver_bound():
    """The grid over a vocabulary of 1.7 million terms (1 GB of documents): each model is sent, no group is beyond its bound."""
    from sentimetry.plans.q_topics import K_GRID
    groups = LDA._groups(K_GRID, 1_700_000, min(LDA.BROADCAST_CELLS, LDA.GROUP_CELLS))
    assert [m for g in groups for m in g] == list(range(len(K_GRID)))
    assert max(1_700_000 * sum(K_GRID[m] for m in g) for g in groups) <= LDA.GROUP_CELLS <= LDA.BROADCAST_CELLS
