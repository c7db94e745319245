"""Registered queries: lexicon construction.

Lexicons are parameters, so every query here mixes them with data taken from
the corpus: phrases mined from the text, or its most frequent terms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dtm as D
from ..operators import lexicon as L
from ..operators import tokens as TK
from ..sources import fixtures as fx
from . import sql as Q
from .common import corpus
from .q_dtm import DTM_SQL
from .q_text import ASCII_LOWER_SQL, PHRASE_PATTERNS, _ascii_lower
from .registry import register

# The hand-made entries of the reference's own lexicon, in order.
CUSTOM_ENTRIES = [
    ("approve", 2), ("release", 2), ("below average", -1), ("loss of", -2), ("develop new drug", 2),
    ("late stage study", 1), ("rise cost of", -2), ("share sink", -1), ("not be able to recover", -3),
    ("overweight", -2), ("must", -2), ("high price", -3), ("low return", -3),
]


def _mined(spark, sf):
    return TK.extract_phrases(corpus(spark, sf).select(_ascii_lower().alias("text")), PHRASE_PATTERNS)


def _custom(spark, sf):
    return L.lexicon_custom(spark, CUSTOM_ENTRIES, _mined(spark, sf))


def _custom_sql():
    parts = " UNION ALL ".join(
        f"SELECT regexp_extract({ASCII_LOWER_SQL}, {Q.q(p)}, 0) AS w, {s!r} AS s, {i} AS pattern FROM corpus"
        for i, (p, s) in enumerate(PHRASE_PATTERNS))
    fixed = Q.values([(w, float(s), 1000 + i) for i, (w, s) in enumerate(CUSTOM_ENTRIES)], ["x", "y", "pos"])
    return f"""mined AS (SELECT w AS x, s AS y, min(pattern) AS pos FROM ({parts}) WHERE w <> '' GROUP BY 1, 2),
custom AS (SELECT 'myLexicon' AS lexicon, x, y, pos FROM mined UNION ALL SELECT 'myLexicon', x, y, pos FROM {fixed})"""


@register("lexicon_custom", Q.with_(Q.CORPUS, _custom_sql()) + "SELECT lexicon, x, y FROM custom")
def lexicon_custom(spark, sf):
    """Mined phrases plus the hand-made entries as one lexicon."""
    return _custom(spark, sf).select("lexicon", "x", "y")


@register("lexicon_setup", Q.with_(Q.CORPUS, _custom_sql(), Q.LEXICON, Q.VALENCE) + """,
allx AS (SELECT lexicon, x, y, pos FROM lex_raw UNION ALL
  SELECT lexicon, x, y, pos FROM custom),
firsts AS (SELECT lexicon, lower(trim(x)) AS x, CAST(y AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY lexicon, lower(trim(x)) ORDER BY pos) AS rn FROM allx)
SELECT lexicon || CASE WHEN y > 0 THEN '_POS' ELSE '_NEG' END AS lexicon, x, y FROM firsts
WHERE rn = 1 AND y <> 0 AND x NOT IN (SELECT lower(x) FROM valence)""".replace("WITH ", "WITH ", 1))
def lexicon_setup(spark, sf):
    """Lower-case, first entry per word, shifters dropped, split into
    _POS / _NEG lexicons; over the fixed lexicons plus the mined one."""
    lx = L.lexicon_merge(fx.lexicons(spark), _custom(spark, sf))
    return L.lexicon_setup(lx, fx.valence(spark), do_split=True)


@register("lexicon_remove_words", DTM_SQL + f""", {Q.LEXICON},
top AS (SELECT term FROM dtm GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 10)
SELECT lexicon, x, y FROM lex_raw WHERE x NOT IN (SELECT term FROM top)""".replace("\n, ", ", ", 1))
def lexicon_remove_words(spark, sf):
    """The corpus' ten most frequent terms removed from every lexicon."""
    top = D.top_terms(D.dtm_build(corpus(spark, sf), fx.STOPWORDS), 10).select("term")
    return L.lexicon_remove_words(fx.lexicons(spark), top).select("lexicon", "x", "y")


@register("lexicon_merge", Q.with_(Q.CORPUS, _custom_sql(), Q.LEXICON) +
          "SELECT lexicon, x, y FROM lex_raw UNION ALL SELECT lexicon, x, y FROM custom")
def lexicon_merge(spark, sf):
    """Fixed and mined lexicons as one set."""
    return L.lexicon_merge(fx.lexicons(spark).drop("pos"), _custom(spark, sf).drop("pos")).select("lexicon", "x", "y")


@register("lexicon_membership", DTM_SQL + f""", {Q.LEXICON},
top AS (SELECT term FROM dtm GROUP BY 1 ORDER BY sum(n) DESC, term LIMIT 20),
names AS (SELECT DISTINCT lexicon FROM lex_raw)
SELECT t.term AS word, n.lexicon, EXISTS (SELECT 1 FROM lex_raw l WHERE l.lexicon = n.lexicon AND l.x = t.term) AS listed
FROM top t CROSS JOIN names n""".replace("\n, ", ", ", 1))
def lexicon_membership(spark, sf):
    """Is each of the 20 most frequent terms listed in each lexicon?"""
    top = D.top_terms(D.dtm_build(corpus(spark, sf), fx.STOPWORDS), 20).select(F.col("term").alias("word"))
    return L.lexicon_membership(top, fx.lexicons(spark))


@register("terms_not_in_lexicons", DTM_SQL + f""", {Q.LEXICON},
top AS (SELECT term, sum(n) AS total FROM dtm GROUP BY 1 ORDER BY total DESC, term LIMIT 30)
SELECT term, total FROM top WHERE term NOT IN (SELECT x FROM lex_raw)""".replace("\n, ", ", ", 1))
def terms_not_in_lexicons(spark, sf):
    """Top-30 terms minus all lexicon words."""
    top = D.top_terms(D.dtm_build(corpus(spark, sf), fx.STOPWORDS), 30)
    return L.terms_not_in_lexicons(top, fx.lexicons(spark))
