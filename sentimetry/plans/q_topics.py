"""Registered queries: topic models and topic tables (O83–O100).

Relational operators run on the stand-in θ (embeddings) and φ (per-language
term shares) of FIXTURES.md, which have exact SQL twins; fitted models are
rows-only."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import nonblank_runs
from ..operators import dtm as D
from ..operators import tokens as TK
from ..operators import topics as TP
from ..sources import fixtures as fx
from . import sql as Q
from .common import corpus, r6, s6
from .q_dtm import DTM_SQL
from .registry import register
from ..session import materialize

THETA_SQL = """th AS (SELECT vec_id AS doc_id, i AS topic,
  abs(CAST(embedding[i] AS DOUBLE)) / list_sum(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))))
  AS theta FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
cat AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS category FROM embeddings)"""
PHI_SQL = """vocab AS (SELECT DISTINCT term FROM dtm WHERE length(term) >= 3),
langs AS (SELECT DISTINCT lang FROM corpus),
cnt AS (SELECT c.lang, d.term, sum(d.n) AS n FROM dtm d JOIN corpus c ON c.id = d.id
  WHERE d.term IN (SELECT term FROM vocab) GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS s FROM cnt GROUP BY 1),
phi AS (SELECT l.lang AS topic, v.term, (coalesce(c.n, 0) + 1.0) / (coalesce(t.s, 0) + (SELECT count(*) FROM vocab)) AS phi
  FROM langs l CROSS JOIN vocab v LEFT JOIN cnt c ON c.lang = l.lang AND c.term = v.term
  LEFT JOIN tot t ON t.lang = l.lang)"""
PHI_ALL = DTM_SQL + ", " + PHI_SQL + "\n"
THETA_ALL = Q.with_(THETA_SQL)


def theta_standin(spark, sf):
    return fx.theta(spark, sf)


def phi_counts(spark, sf):
    """Counts by language and term of three letters or more, written once."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    toks = TK.word_tokens(corpus(spark, sf), stopwords=fx.STOPWORDS).where(F.length("term") >= 3)
    return materialize(toks.join(docs, "id").groupBy("lang", "term").agg(F.count("*").alias("n")), "phi-counts")


def phi_standin(spark, sf, cnt=None):
    """φ(topic = language, term) = (n + 1) / (Σn + V) over the V terms of
    three letters or more.

    One pass over the text: counts by language and term, written once, give the
    totals, the vocabulary's size and the grid of languages and terms."""
    docs = fx.table(spark, sf, "documents").select("lang")
    cnt = phi_counts(spark, sf) if cnt is None else cnt
    tot = cnt.groupBy("lang").agg(F.sum("n").alias("s"))
    langs = docs.select(F.sort_array(F.collect_set("lang"))).scalar()
    by_term = cnt.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang"))
    size = cnt.select(F.countDistinct("term")).scalar()
    grid = by_term.select("term", F.explode(langs).alias("lang"), "by_lang").select(
        "term", "lang", F.coalesce(F.try_element_at("by_lang", "lang"), F.lit(0)).alias("n"))
    return (grid.join(tot, "lang", "left")
            .select(F.col("lang").alias("topic"), "term",
                    ((F.col("n") + 1.0) / (F.coalesce("s", F.lit(0)) + size)).alias("phi")))


@register("topic_of_doc", THETA_ALL + """SELECT doc_id, topic FROM (SELECT doc_id, topic,
  row_number() OVER (PARTITION BY doc_id ORDER BY theta DESC, topic) AS rn FROM th) WHERE rn = 1""")
def topic_of_doc(spark, sf):
    """Most likely topic per document."""
    return TP.topic_of_doc(theta_standin(spark, sf))


TOP_SQL = PHI_ALL[:-1] + """, top AS (SELECT topic, term, phi, row_number() OVER (PARTITION BY topic
  ORDER BY phi DESC, term) AS rank FROM phi)
"""


@register("topic_top_terms", TOP_SQL + f"SELECT topic, term, {s6('phi')} AS phi, rank FROM top WHERE rank <= 20")
def topic_top_terms(spark, sf):
    """Top 20 terms per topic with rank."""
    t = TP.topic_top_terms(phi_standin(spark, sf), 20)
    return t.select("topic", "term", r6("phi").alias("phi"), F.col("rank").cast("long").alias("rank"))


@register("topic_label", TOP_SQL + "SELECT topic, string_agg(term, ' ' ORDER BY rank) AS label FROM top "
          "WHERE rank <= 3 GROUP BY topic")
def topic_label(spark, sf):
    """Three best terms joined by a blank."""
    return TP.topic_label(TP.topic_top_terms(phi_standin(spark, sf), 20), 3)


@register("docs_with_topic", Q.with_(Q.CORPUS, THETA_SQL) + """, tod AS (SELECT doc_id, topic FROM (SELECT doc_id,
  topic, row_number() OVER (PARTITION BY doc_id ORDER BY theta DESC, topic) AS rn FROM th) WHERE rn = 1)
SELECT c.id, c.date, t.topic FROM corpus c JOIN tod t ON t.doc_id = c.id""".replace("\n, tod", ", tod"))
def docs_with_topic(spark, sf):
    """Corpus inner-joined with each document's topic."""
    out = TP.docs_with_topic(corpus(spark, sf), TP.topic_of_doc(theta_standin(spark, sf)))
    return out.select("id", "date", "topic")


@register("topic_share", Q.with_(Q.CORPUS, THETA_SQL) + """, len AS (SELECT id AS doc_id,
  len(regexp_extract_all(text, '\\S+')) AS len FROM corpus),
j AS (SELECT t.topic, t.theta, l.len, l.doc_id FROM th t JOIN len l USING (doc_id))
SELECT topic, """ + s6("sum(theta * len) / (SELECT sum(len) FROM (SELECT DISTINCT doc_id, len FROM j))") +
          """ AS share FROM j GROUP BY topic""".replace("\n, len", ", len"))
def topic_share(spark, sf):
    """Topic size Σ θ·len / Σ len."""
    lens = corpus(spark, sf).select(F.col("id").alias("doc_id"), nonblank_runs("text").alias("len"))
    return TP.topic_share(theta_standin(spark, sf), lens).select("topic", r6("share").alias("share"))


@register("topic_term_relevance", PHI_ALL[:-1] + """, tf AS (SELECT term, sum(n) AS freq FROM dtm
  WHERE term IN (SELECT term FROM vocab) GROUP BY 1),
pt AS (SELECT term, freq / (SELECT sum(freq) FROM tf) AS pterm FROM tf),
base AS (SELECT p.topic, p.term, ln(p.phi) AS logprob, ln(p.phi / t.pterm) AS loglift FROM phi p JOIN pt t USING (term)),
rel AS (SELECT b.*, l.lam, l.lam * logprob + (1 - l.lam) * loglift AS relevance
  FROM base b CROSS JOIN (VALUES (0.0), (0.5), (1.0)) AS l(lam)),
rk AS (SELECT *, row_number() OVER (PARTITION BY lam, topic ORDER BY relevance DESC, term) AS rank FROM rel)
SELECT CAST(lam AS DOUBLE) AS "lambda", topic, term, rank, """ + s6("relevance") + " AS relevance, " +
          s6("logprob") + " AS logprob, " + s6("loglift") + " AS loglift FROM rk WHERE rank <= 30")
def topic_term_relevance(spark, sf):
    """Per λ ∈ {0, .5, 1} the 30 most relevant terms of each topic."""
    cnt = phi_counts(spark, sf)
    phi = phi_standin(spark, sf, cnt)
    tf = cnt.groupBy("term").agg(F.sum("n").alias("freq"))
    r = TP.topic_term_relevance(phi, tf, [0.0, 0.5, 1.0], 30)
    return r.select("lambda", "topic", "term", F.col("rank").cast("long").alias("rank"),
                    r6("relevance").alias("relevance"), r6("logprob").alias("logprob"), r6("loglift").alias("loglift"))


PAIRS_SQL = PHI_ALL[:-1] + """, pr AS (SELECT a.topic AS t1, b.topic AS t2, a.phi AS p, b.phi AS q FROM phi a
  JOIN phi b ON a.term = b.term AND a.topic < b.topic)
"""


@register("topic_distance", PAIRS_SQL + "SELECT t1, t2, " +
          s6("0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2)))") +
          " AS jsd FROM pr GROUP BY 1, 2")
def topic_distance(spark, sf):
    """Jensen–Shannon divergence of each topic pair."""
    return TP.topic_distance(phi_standin(spark, sf)).select("t1", "t2", r6("jsd").alias("jsd"))


TBC_SQL = Q.with_(THETA_SQL)[:-1] + """, tbc AS (SELECT c.category, t.topic, avg(t.theta) AS mean_theta FROM th t
  LEFT JOIN cat c USING (doc_id) GROUP BY 1, 2)
"""


def _tbc(spark, sf):
    return TP.theta_by_category(theta_standin(spark, sf), fx.category(spark, sf))


@register("theta_by_category", TBC_SQL + f"SELECT category, topic, {s6('mean_theta')} AS mean_theta FROM tbc")
def theta_by_category(spark, sf):
    """Mean θ per category and topic."""
    return _tbc(spark, sf).select("category", "topic", r6("mean_theta").alias("mean_theta"))


@register("topic_correlation", TBC_SQL + "SELECT a.topic AS t1, b.topic AS t2, " + s6("corr(a.mean_theta, b.mean_theta)")
          + " AS r FROM tbc a JOIN tbc b ON a.category = b.category AND a.topic < b.topic GROUP BY 1, 2")
def topic_correlation(spark, sf):
    """Correlation of topics over categories."""
    return TP.topic_correlation(_tbc(spark, sf)).select("t1", "t2", r6("r").alias("r"))


@register("topic_diagnostic_ratio", TBC_SQL + """, rt AS (SELECT category, topic,
  mean_theta / (sum(mean_theta) OVER (PARTITION BY category) - mean_theta) AS ratio FROM tbc)
SELECT category, topic, """ + s6("ratio") + """ AS ratio,
  row_number() OVER (PARTITION BY category ORDER BY ratio DESC, topic) AS rank FROM rt""")
def topic_diagnostic_ratio(spark, sf):
    """Per category, topic θ over the sum of the others, ranked."""
    r = TP.topic_diagnostic_ratio(_tbc(spark, sf))
    return r.select("category", "topic", r6("ratio").alias("ratio"), F.col("rank").cast("long").alias("rank"))


@register("metric_cao_juan", PAIRS_SQL + """, nr AS (SELECT topic, sqrt(sum(phi * phi)) AS n FROM phi GROUP BY 1)
SELECT """ + s6("avg(d.dot / (a.n * b.n))") + """ AS value FROM (SELECT t1, t2, sum(p * q) AS dot FROM pr GROUP BY 1, 2) d
JOIN nr a ON a.topic = d.t1 JOIN nr b ON b.topic = d.t2""")
def metric_cao_juan(spark, sf):
    """Mean pairwise cosine of topics."""
    return TP.metric_cao_juan(phi_standin(spark, sf)).select(r6("value").alias("value"))


@register("metric_deveaud", PAIRS_SQL + "SELECT " +
          s6("sum(d) / ((SELECT count(DISTINCT topic) FROM phi) * ((SELECT count(DISTINCT topic) FROM phi) - 1))") +
          """ AS value FROM (SELECT t1, t2,
  0.5 * sum(p * ln(p / q)) + 0.5 * sum(q * ln(q / p)) AS d FROM pr GROUP BY 1, 2)""")
def metric_deveaud(spark, sf):
    """Mean symmetric divergence of topic pairs."""
    return TP.metric_deveaud(phi_standin(spark, sf)).select(r6("value").alias("value"))


# --- fitted models (rows-only) ---------------------------------------------------
K_TOPICS = 10
K_GRID = list(range(2, 16))


def _topic_dtm(spark, sf):
    """Topic DTM pruned at the median tf-idf score; the text is tokenised once."""
    c = corpus(spark, sf)
    tdtm = materialize(D.topic_dtm(c, fx.STOPWORDS, 3, True), "topic-dtm")
    return materialize(D.prune_by_tfidf(tdtm, None, D.n_documents(c)), "pruned-dtm")


def _models(spark, sf, ks, seed):
    """(models, row sums of the DTM they saw)."""
    dtm, docs = _topic_dtm(spark, sf), corpus(spark, sf)
    return TP.lda_em(dtm, docs, ks, seed), D.doc_lengths(dtm, docs)


@register("lda_fit", None)
def lda_fit(spark, sf):
    """LDA with k = 10 on the tf-idf-pruned topic DTM; top 20 terms."""
    dtm = materialize(D.topic_dtm(corpus(spark, sf), fx.STOPWORDS, 3, True), "topic-dtm")
    return TP.topic_model(dtm, corpus(spark, sf), "tf-idf", k=K_TOPICS, seed=622)["terms"]


@register("topic_posteriors", None)
def topic_posteriors(spark, sf):
    """θ of every document and φ of every term, as one table."""
    m, _ = _models(spark, sf, [K_TOPICS], 622)
    return m.theta_long().select(F.lit("theta").alias("kind"), F.col("doc_id").cast("string").alias("key"), "topic",
                                 F.col("theta").alias("value")).unionByName(
        m.phi_long().select(F.lit("phi").alias("kind"), F.col("term").alias("key"), "topic", F.col("phi").alias("value")))


@register("topic_count_grid", None)
def topic_count_grid(spark, sf):
    """k = 2..15, fitted side by side and scored by four metrics."""
    m, lens = _models(spark, sf, K_GRID, 77)
    return TP.score_models(spark, m, lens)


@register("metric_arun", None)
def metric_arun(spark, sf):
    """Arun2010 for the k = 10 fit."""
    m, lens = _models(spark, sf, [K_TOPICS], 77)
    v = TP.metric_arun(m.phi_long(), m.theta_long(), lens)
    return spark.createDataFrame([(K_TOPICS, "Arun2010", v)], "k int, metric string, value double")


@register("metric_griffiths", None)
def metric_griffiths(spark, sf):
    """Log-likelihood of the k = 10 fit (named griffiths_bound)."""
    m, _ = _models(spark, sf, [K_TOPICS], 77)
    return spark.createDataFrame([(K_TOPICS, "griffiths_bound", float(m.log_likelihood[0]))],
                                 "k int, metric string, value double")


@register("metric_normalise", None)
def metric_normalise(spark, sf):
    """O100: min-max scaled metrics over the k grid."""
    m, lens = _models(spark, sf, K_GRID, 77)
    return TP.metric_normalise(TP.score_models(spark, m, lens))
