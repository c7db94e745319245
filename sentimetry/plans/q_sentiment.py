"""Registered queries: document sentiment."""

from __future__ import annotations


from ..operators import dtm as D
from ..operators import sentiment as S
from ..sources import fixtures as fx
from . import sql as Q
from .common import LEX_NAMES, corpus, lexicons, r6, s6
from ..session import materialize
from .registry import register

PRE = [Q.CORPUS, Q.FEATS, Q.TOKS, Q.LEXICON, Q.VALENCE, Q.LEX_SETUP]


def _scores(spark, sf, how, valence=True, units=("word", "sentence"), phrase_mode="unit"):
    val = fx.valence(spark) if valence else None
    return S.score_documents(corpus(spark, sf), lexicons(spark), val, fx.STOPWORDS, how, units, phrase_mode,
                             names=LEX_NAMES)


def _out(df):
    return df.select("id", "word_count", "lexicon", r6("score").alias("score"))


def _sql(how, **kw):
    return Q.with_(*PRE)[:-1] + ",\n" + Q.doc_scores_sql(how, **kw) + \
        f"\nSELECT id, word_count, lexicon, {s6('score')} AS score FROM doc_scores"


@register("sent_counts", _sql("counts", valence=False))
def sent_counts(spark, sf):
    """Σ n·y per document and lexicon (word + sentence units, no shifters)."""
    return _out(_scores(spark, sf, "counts", valence=False))


@register("sent_proportional", _sql("proportional", valence=False))
def sent_proportional(spark, sf):
    """Σ n·y / word_count."""
    return _out(_scores(spark, sf, "proportional", valence=False))


@register("sent_tfidf", _sql("tf-idf", valence=False))
def sent_tfidf(spark, sf):
    """Σ tfidf·y with tf = n/word_count, idf = log10(N/df)."""
    return _out(_scores(spark, sf, "tf-idf", valence=False))


@register("sent_word_count", Q.with_(*PRE)[:-1] + ",\n" + Q.units_sql(valence=False) +
          "\nSELECT id, word_count FROM wc")
def sent_word_count(spark, sf):
    """word_count = kept words + kept sentence units."""
    return _scores(spark, sf, "counts", valence=False).select("id", "word_count").distinct()


@register("sent_by_feature", Q.with_(*PRE)[:-1] + ",\n" + Q.doc_sentiment_sql("proportional") +
          f"\nSELECT id, date, lexicon, feature, {s6('score')} AS score FROM doc_sent")
def sent_by_feature(spark, sf):
    """Lexicon score × feature weight, one row per lexicon × feature."""
    ds = S.sentiment_by_feature(_scores(spark, sf, "proportional"))
    return ds.select("id", "date", "lexicon", "feature", r6("score").alias("score"))


@register("sent_valence", _sql("counts", valence=True, units=("word",)))
def sent_valence(spark, sf):
    """A lexicon word right after a shifter counts y × multiplier."""
    return _out(_scores(spark, sf, "counts", valence=True, units=("word",)))


@register("sent_phrases", _sql("counts", valence=False, units=("word",), ngram_lengths=(2,)))
def sent_phrases(spark, sf):
    """O63, n-gram mode: multi-word entries matched anywhere in the text."""
    return _out(_scores(spark, sf, "counts", valence=False, units=("word",), phrase_mode="ngram"))


@register("sent_phrases_unit", _sql("counts", valence=False, units=("word", "sentence")))
def sent_phrases_unit(spark, sf):
    """O63, unit mode (the reference): a phrase only matches a whole sentence."""
    return _out(_scores(spark, sf, "counts", valence=False, units=("word", "sentence"), phrase_mode="unit"))


@register("sent_from_dtm", Q.with_(*PRE)[:-1] + """,
dtm AS (SELECT id, term, count(*) AS n FROM words_prev WHERE term NOT IN """ + Q.STOP_LIST + """ GROUP BY 1, 2),
wcs AS (SELECT c.id, coalesce(sum(d.n), 0) AS wc FROM corpus c LEFT JOIN dtm d ON d.id = c.id GROUP BY 1),
nd AS (SELECT count(*) AS n FROM corpus),
dfreq AS (SELECT term, count(*) AS df FROM dtm GROUP BY 1),
raw AS (SELECT d.id, l.lexicon, sum(d.n * log10((SELECT n FROM nd) / f.df) * l.y) AS s
  FROM dtm d JOIN dfreq f USING (term) JOIN lex l ON l.x = d.term GROUP BY 1, 2),
names AS (SELECT DISTINCT lexicon FROM lex)
SELECT w.id, CAST(w.wc AS DOUBLE) AS word_count, n.lexicon, """ + s6("coalesce(r.s / nullif(w.wc, 0), 0)") + """ AS score
FROM wcs w CROSS JOIN names n LEFT JOIN raw r ON r.id = w.id AND r.lexicon = n.lexicon""")
def sent_from_dtm(spark, sf):
    """Score a ready document-term table (tf-idf)."""
    dtm = materialize(D.dtm_build(corpus(spark, sf), fx.STOPWORDS), "dtm")
    out = S.score_dtm(dtm, lexicons(spark), "tf-idf", corpus(spark, sf))
    return out.select("id", "word_count", "lexicon", r6("score").alias("score"))
