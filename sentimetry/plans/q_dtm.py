"""Registered queries: document-term tables and term statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dtm as D
from ..sources import fixtures as fx
from . import sql as Q
from ..session import materialize
from .common import corpus, r6, s6
from .q_text import TOPIC_DTM_SQL
from .registry import register

DTM_SQL = Q.with_(Q.CORPUS, Q.TOKS)[:-1] + f""",
dtm AS (SELECT id, term, count(*) AS n FROM words_all WHERE term NOT IN {Q.STOP_LIST} GROUP BY 1, 2)
"""
TDTM = Q.with_(Q.CORPUS, TOPIC_DTM_SQL)


def _dtm(spark, sf, with_len=False):
    return D.dtm_build(corpus(spark, sf), fx.STOPWORDS, with_len=with_len)


def _tdtm(spark, sf, with_len=True):
    """The topic DTM, written once: statistics and pruning both read it, and
    the text is tokenised once."""
    return materialize(D.topic_dtm(corpus(spark, sf), fx.STOPWORDS, 3, with_len), "topic-dtm")


def _n_docs(spark, sf):
    return D.n_documents(corpus(spark, sf))


@register("dtm_build", DTM_SQL + "SELECT id, term, n FROM dtm")
def dtm_build(spark, sf):
    """Document × term counts."""
    return _dtm(spark, sf)


@register("dtm_slice", DTM_SQL + """, d20 AS (SELECT DISTINCT id FROM dtm ORDER BY id LIMIT 20),
t20 AS (SELECT DISTINCT term FROM dtm ORDER BY term LIMIT 20)
SELECT d.id, t.term, coalesce(x.n, 0) AS n FROM d20 d CROSS JOIN t20 t LEFT JOIN dtm x ON x.id = d.id AND x.term = t.term"""
          .replace("\n, d20", ", d20"))
def dtm_slice(spark, sf):
    """The dense 20 × 20 top-left block with zeros."""
    return D.dtm_slice(materialize(_dtm(spark, sf), "dtm"), 20, 20)


@register("dtm_union_units", Q.with_(Q.CORPUS)[:-1] + f""",
ct AS (SELECT id, regexp_replace(lower(text), '[^\\p{{L}}+ \\t.!?]', ' ', 'g') AS t FROM corpus),
toks AS (SELECT id, {Q.SPLIT.format(x="regexp_replace(t, '[^\\p{L}+ \\t]', ' ', 'g')")} AS tok FROM ct),
w AS (SELECT id, unnest(tok) AS term FROM toks),
s AS (SELECT id, unnest(list_transform(string_split_regex(t, '[.!?]+\\s+'),
  lambda x: array_to_string({Q.SPLIT.format(x="lower(regexp_replace(x, '(^'')|(''s\\z)|[^\\p{L}+ \\t]', ' ', 'g'))")},
  ' '))) AS term FROM ct)
SELECT id, term, count(*) AS n, 'word' AS unit FROM w WHERE term NOT IN {Q.STOP_LIST} GROUP BY 1, 2
UNION ALL
SELECT id, term, count(*) AS n, 'sentence' AS unit FROM s WHERE term <> '' AND term NOT IN {Q.STOP_LIST} GROUP BY 1, 2""")
def dtm_union_units(spark, sf):
    """Word and sentence counts side by side (``unit`` column)."""
    return D.dtm_union_units(corpus(spark, sf), fx.STOPWORDS)


@register("top_terms", DTM_SQL + "SELECT term, sum(n) AS total FROM dtm GROUP BY 1 ORDER BY total DESC, term LIMIT 50")
def top_terms(spark, sf):
    """The 50 most frequent terms."""
    return D.top_terms(_dtm(spark, sf), 50)


@register("doc_frequency", DTM_SQL + "SELECT term, count(*) AS df FROM dtm GROUP BY 1")
def doc_frequency(spark, sf):
    """Documents per term."""
    return D.doc_frequency(_dtm(spark, sf))


@register("frequent_terms", DTM_SQL + "SELECT term, sum(n) AS total FROM dtm GROUP BY 1 HAVING sum(n) >= 100")
def frequent_terms(spark, sf):
    """Terms with total count ≥ 100."""
    return D.frequent_terms(_dtm(spark, sf), 100)


@register("doc_term_totals", DTM_SQL + """SELECT 'doc' AS kind, CAST(c.id AS VARCHAR) AS k, coalesce(sum(d.n), 0) AS total
FROM corpus c LEFT JOIN dtm d ON d.id = c.id GROUP BY c.id
UNION ALL SELECT 'term', term, sum(n) FROM dtm GROUP BY term""")
def doc_term_totals(spark, sf):
    """Row sums and column sums in one table (``kind`` tells them apart)."""
    d = materialize(_dtm(spark, sf), "dtm")
    rows = D.doc_lengths(d, corpus(spark, sf)).select(F.lit("doc").alias("kind"), F.col("id").cast("string").alias("k"),
                                   F.col("doc_len").alias("total"))
    cols = D.term_totals(d).select(F.lit("term").alias("kind"), F.col("term").alias("k"), F.col("freq").alias("total"))
    return rows.unionByName(cols)


@register("tfidf_docs", DTM_SQL + f""", len AS (SELECT id, sum(n) AS l FROM dtm GROUP BY 1),
dfr AS (SELECT term, count(*) AS df FROM dtm GROUP BY 1), nd AS (SELECT count(*) AS n FROM corpus)
SELECT d.id, d.term, {s6('d.n / l.l * log10((SELECT n FROM nd) / f.df)')} AS tfidf
FROM dtm d JOIN len l USING (id) JOIN dfr f USING (term)""".replace("\n, len", ", len"))
def tfidf_docs(spark, sf):
    """Proportional tf × log10 idf."""
    dtm = materialize(_dtm(spark, sf, True), "dtm")
    return D.tfidf_docs(dtm, _n_docs(spark, sf)).select("id", "term", r6("tfidf").alias("tfidf"))


TFIDF_MEAN_SQL = TDTM[:-1] + """,
len AS (SELECT id, sum(n) AS l FROM tdtm GROUP BY 1), nd AS (SELECT count(*) AS n FROM corpus),
score AS (SELECT t.term, avg(t.n / l.l) * log2((SELECT n FROM nd) / count(*)) AS score
  FROM tdtm t JOIN len l USING (id) GROUP BY t.term)
"""


@register("term_tfidf_mean", TFIDF_MEAN_SQL + f"SELECT term, {s6('score')} AS score FROM score")
def term_tfidf_mean(spark, sf):
    """Mean n/doc_len over the term's documents × log2(N/df)."""
    dtm = D.topic_dtm(corpus(spark, sf), fx.STOPWORDS, 3, True)
    return D.term_tfidf_mean(dtm, _n_docs(spark, sf)).select("term", r6("score").alias("score"))


@register("six_number_summary", TFIDF_MEAN_SQL + f"""SELECT {s6('min(score)')} AS min,
  {s6('quantile_cont(score, 0.25)')} AS q1, {s6('quantile_cont(score, 0.5)')} AS median, {s6('avg(score)')} AS mean,
  {s6('quantile_cont(score, 0.75)')} AS q3, {s6('max(score)')} AS max FROM score""")
def six_number_summary(spark, sf):
    """Summary of the O47 term scores."""
    dtm = D.topic_dtm(corpus(spark, sf), fx.STOPWORDS, 3, True)
    s = D.six_number_summary(D.term_tfidf_mean(dtm, _n_docs(spark, sf)), "score")
    return s.select(*[r6(c).alias(c) for c in s.columns])


@register("prune_by_tfidf", TFIDF_MEAN_SQL + """SELECT id, term, n FROM tdtm
WHERE term IN (SELECT term FROM score WHERE score >= (SELECT quantile_cont(score, 0.5) FROM score))""")
def prune_by_tfidf(spark, sf):
    """Keep terms scoring at least the median."""
    return D.prune_by_tfidf(_tdtm(spark, sf), None, _n_docs(spark, sf))


@register("prune_by_tfidf_const", TFIDF_MEAN_SQL + """SELECT id, term, n FROM tdtm
WHERE term IN (SELECT term FROM score WHERE score >= 0.022781)""")
def prune_by_tfidf_const(spark, sf):
    """O49 with the reference's constant threshold 0.022781."""
    return D.prune_by_tfidf(_tdtm(spark, sf), 0.022781, _n_docs(spark, sf))


@register("prune_sparse_terms", TDTM[:-1] + """, nd AS (SELECT count(*) AS n FROM corpus),
dfr AS (SELECT term, count(*) AS df FROM tdtm GROUP BY 1)
SELECT id, term, n FROM tdtm WHERE term IN (SELECT term FROM dfr WHERE df > (SELECT n FROM nd) * (1 - 0.99))""")
def prune_sparse_terms(spark, sf):
    """``removeSparseTerms(DTM, 0.99)``."""
    return D.prune_sparse_terms(_tdtm(spark, sf, False), 0.99, _n_docs(spark, sf))
