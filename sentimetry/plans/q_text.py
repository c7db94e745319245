"""Registered queries: corpus operators and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus_ops as CO
from ..operators import dtm as D
from ..operators import tokens as TK
from ..sources import corpus as C
from ..sources import fixtures as fx
from . import sql as Q
from .common import corpus, r6, s6
from .registry import register

CORPUS_ONLY = Q.with_(Q.CORPUS)
CT = Q.with_(Q.CORPUS, Q.FEATS)

# Patterns of the phrase-mining fixture, in the three forms the
# reference uses (bounded gap, lazy proximity, anchored pair), with scores.
PHRASE_PATTERNS = [
    (r"than\s*([a-z]+\s*){1,5}thor", -2.0),
    (r"\b(with|by)(?:\W+\w+){0,2}?\W+(the)\b", 3.0),
    (r"\b(this)\b\s*?\b(is)(?:\W+\w+){0,2}?\W+(and)\b", -2.0),
]
KEYWORDS = {"kw_a": ["thor", "erin"], "kw_b": ["resh", "zzzq"], "kw_c": ["ble"]}
EXCLUDE_PATTERN = "thatin"
SPLIT_DATE = "1998-07-01"


def _ascii_lower(col="text"):
    return T.text_to_ascii(F.lower(F.col(col)))


ASCII_LOWER_SQL = "regexp_replace(lower(text), '[^\\x00-\\x7F]', '', 'g')"


@register("corpus_build", CT + """, ln AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM corpus)
SELECT c.id, """ + s6("(c.n_chars - ln.lo) / CAST(ln.hi - ln.lo AS DOUBLE)") + """ AS length,
  """ + s6("CAST(c.src % 3 = 0 AS DOUBLE)") + """ AS press FROM corpus c, ln""")
def corpus_build(spark, sf):
    """A feature outside [0, 1] (text length) is min-max scaled."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars")
    c = corpus(spark, sf).join(docs.withColumnRenamed("doc_id", "id"), "id")
    c = c.withColumn("features", F.map_concat("features", F.create_map(F.lit("length"),
                                                                       F.col("n_chars").cast("double"))))
    out = C.corpus_build(c.drop("n_chars"))
    return out.select("id", r6(F.col("features")["length"]).alias("length"),
                      r6(F.col("features")["press"]).alias("press"))


@register("feature_names", CT + "SELECT DISTINCT feature FROM feats")
def feature_names(spark, sf):
    """The dynamic feature set."""
    return TK.feature_names(corpus(spark, sf))


@register("exclude_matching_docs", CORPUS_ONLY + f"SELECT id, date FROM corpus WHERE NOT regexp_matches(text, "
          f"{Q.q(EXCLUDE_PATTERN)})")
def exclude_matching_docs(spark, sf):
    """Documents whose text does not match the pattern."""
    return CO.exclude_matching(corpus(spark, sf), EXCLUDE_PATTERN).select("id", "date")


@register("filter_date_after", CORPUS_ONLY + f"SELECT id, date FROM corpus WHERE date > DATE '{SPLIT_DATE}'")
def filter_date_after(spark, sf):
    """Documents after a date (pushed to the scan as a date predicate)."""
    return CO.filter_date_after(corpus(spark, sf), SPLIT_DATE).select("id", "date")


@register("filter_feature_ne", CT + "SELECT id FROM feats WHERE feature = 'press' AND w <> 1")
def filter_feature_ne(spark, sf):
    """Documents whose ``press`` feature is not 1."""
    return CO.filter_feature_ne(corpus(spark, sf), "press", 1.0).select("id")


@register("docs_on_event_dates", Q.with_(Q.CORPUS, Q.TIMELINE) +
          "SELECT id, date FROM corpus WHERE date IN (SELECT date FROM timeline)")
def docs_on_event_dates(spark, sf):
    """Documents dated exactly on an event (left semi)."""
    return CO.docs_on_event_dates(corpus(spark, sf), fx.timeline(spark)).select("id", "date")


@register("docs_in_event_month", Q.with_(Q.CORPUS, Q.TIMELINE) + """
SELECT t.event, strftime(t.date, '%Y-%m') AS month, count(c.id) AS n_docs FROM timeline t
JOIN corpus c ON strftime(c.date, '%Y-%m') = strftime(t.date, '%Y-%m') GROUP BY 1, 2""")
def docs_in_event_month(spark, sf):
    """Documents of each event's month (all events at once) and counts."""
    return CO.docs_in_event_month(corpus(spark, sf), fx.timeline(spark)).groupBy("event", "month").agg(
        F.count("*").alias("n_docs"))


@register("sample_split", CORPUS_ONLY + f"""SELECT id, CASE WHEN date <= DATE '{SPLIT_DATE}' THEN 'dev' ELSE 'val'
END AS sample FROM corpus""")
def sample_split(spark, sf):
    """Development (≤ split date) / validation (> split date)."""
    return CO.sample_split(corpus(spark, sf), SPLIT_DATE).select("id", "sample")


@register("text_lower", CORPUS_ONLY + "SELECT id, lower(text) AS text FROM corpus")
def text_lower(spark, sf):
    """O21."""
    return corpus(spark, sf).select("id", T.text_lower("text").alias("text"))


@register("text_clean", CORPUS_ONLY + f"SELECT id, {Q.CLEAN_EXPR} AS text FROM corpus")
def text_clean(spark, sf):
    """O22."""
    return corpus(spark, sf).select("id", T.text_clean("text").alias("text"))


@register("text_to_ascii", CORPUS_ONLY + "SELECT id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text "
          "FROM corpus")
def text_to_ascii(spark, sf):
    """O23."""
    return corpus(spark, sf).select("id", T.text_to_ascii("text").alias("text"))


@register("strip_punctuation", CORPUS_ONLY + "SELECT id, regexp_replace(text, '[!-/:-@\\[-`{-~]', '', 'g') AS text "
          "FROM corpus")
def strip_punctuation(spark, sf):
    """O24."""
    return corpus(spark, sf).select("id", T.strip_punctuation("text").alias("text"))


@register("collapse_whitespace", CORPUS_ONLY + "SELECT id, regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g') AS text "
          "FROM corpus")
def collapse_whitespace(spark, sf):
    """O25."""
    return corpus(spark, sf).select("id", T.collapse_whitespace("text").alias("text"))


@register("remove_words", Q.with_(Q.CORPUS, Q.TOKS) + f"""SELECT t.id, coalesce(string_agg(w.term, ' ' ORDER BY w.pos),
  '') AS text FROM toks t LEFT JOIN words_all w ON w.id = t.id AND w.term NOT IN {Q.STOP_LIST} GROUP BY t.id""")
def remove_words(spark, sf):
    """Stop words removed from the cleaned token sequence."""
    c = TK.tokens_array(corpus(spark, sf).select("id", "text"), "text")
    return c.select("id", F.array_join(T.drop_words("tokens", fx.STOPWORDS), " ").alias("text"))


TOPIC_DTM_SQL = f"""ttext AS (SELECT id, regexp_replace(lower(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'),
  '[!-/:-@\\[-`{{-~]', '', 'g')), '[ \\t\\n\\r\\f]+', ' ', 'g') AS t FROM corpus),
ttok AS (SELECT id, unnest(string_split(t, ' ')) AS w FROM ttext),
tdtm AS (SELECT id, term, count(*) AS n FROM (SELECT id, regexp_replace(w, '[0-9]+', '', 'g') AS term FROM ttok
  WHERE w NOT IN {Q.STOP_LIST}) WHERE length(term) >= 3 GROUP BY 1, 2)"""


@register("remove_numbers_minlen", Q.with_(Q.CORPUS, TOPIC_DTM_SQL) + "SELECT id, term, n FROM tdtm")
def remove_numbers_minlen(spark, sf):
    """O27 (with O23–O26): the topic scripts' DTM, digits removed, words of
    three letters or more."""
    return D.topic_dtm(corpus(spark, sf), fx.STOPWORDS, 3)


@register("word_tokens", Q.with_(Q.CORPUS, Q.TOKS) + f"SELECT id, pos - 1 AS pos, term FROM words_all "
          f"WHERE term NOT IN {Q.STOP_LIST}")
def word_tokens(spark, sf):
    """Long tokens, stop words removed, positions of the full text."""
    return TK.word_tokens(corpus(spark, sf), stopwords=fx.STOPWORDS)


SENT_SQL = f"""sents AS (SELECT id, unnest(list_transform(string_split_regex(text, '[.!?]+\\s+'),
  lambda s: array_to_string({Q.SPLIT.format(x=Q.CLEAN_EXPR.replace('text', 's'))}, ' '))) AS unit,
  generate_subscripts(string_split_regex(text, '[.!?]+\\s+'), 1) AS spos FROM corpus)"""


@register("sentence_units", Q.with_(Q.CORPUS, SENT_SQL) + """
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY spos) - 1 AS INTEGER) AS spos, unit
FROM sents WHERE unit <> ''""")
def sentence_units(spark, sf):
    """Sentences of the raw text, each cleaned and joined by blanks."""
    return TK.sentence_units(corpus(spark, sf))


@register("lemmatize", Q.with_(Q.CORPUS, Q.TOKS, Q.DICTIONARY) + """
SELECT t.id, coalesce(string_agg(coalesce(d.lemma, w.term), ' ' ORDER BY w.pos), '') AS text
FROM toks t LEFT JOIN words_all w ON w.id = t.id LEFT JOIN dict d ON d.form = w.term GROUP BY t.id""")
def lemmatize(spark, sf):
    """Cleaned text with every token replaced by its dictionary form."""
    c = corpus(spark, sf).select("id", F.array_join(T.split_tokens(T.text_clean("text")), " ").alias("text"))
    return TK.lemmatize(c, fx.dictionary(spark)).select("id", F.coalesce("text", F.lit("")).alias("text"))


@register("stem_terms", Q.with_(Q.CORPUS, Q.TOKS, Q.DICTIONARY) + f"""
SELECT w.id, coalesce(d.lemma, w.term) AS term, count(*) AS n FROM words_all w LEFT JOIN dict d ON d.form = w.term
WHERE w.term NOT IN {Q.STOP_LIST} GROUP BY 1, 2""")
def stem_terms(spark, sf):
    """DTM of stemmed tokens (stem table supplied by the user)."""
    toks = TK.lemmatize_tokens(TK.word_tokens(corpus(spark, sf), stopwords=fx.STOPWORDS), fx.dictionary(spark))
    return toks.groupBy("id", "term").agg(F.count("*").alias("n"))


def _kw_sql():
    cols = ", ".join(f"CAST(regexp_matches(lower(text), {Q.q('(' + '|'.join(ws) + ')')}) AS DOUBLE) AS {k}"
                     for k, ws in KEYWORDS.items())
    return CORPUS_ONLY + f"SELECT id, {cols} FROM corpus"


@register("keyword_features", _kw_sql())
def keyword_features(spark, sf):
    """0/1 features, 1 when any keyword of the list occurs (substring)."""
    c = corpus(spark, sf).withColumn("text", F.lower("text"))
    out = TK.keyword_features(c, KEYWORDS)
    return out.select("id", *[F.col("features")[k].alias(k) for k in KEYWORDS])


@register("transfer_features", Q.with_(Q.CORPUS, Q.TOKS, Q.DICTIONARY) + """,
lem AS (SELECT t.id, coalesce(string_agg(coalesce(d.lemma, w.term), ' ' ORDER BY w.pos), '') AS text
  FROM toks t LEFT JOIN words_all w ON w.id = t.id LEFT JOIN dict d ON d.form = w.term GROUP BY t.id)
SELECT id, CAST(regexp_matches(text, '(tha)') AS DOUBLE) AS increase,
  CAST(regexp_matches(text, '(eri)') AS DOUBLE) AS detect FROM lem""")
def transfer_features(spark, sf):
    """Keyword features found on the lemmatised corpus, attached to the
    original corpus by id."""
    def derive(c):
        c = c.withColumn("text", F.array_join(T.split_tokens(T.text_clean("text")), " "))
        return TK.keyword_features(TK.lemmatize(c, fx.dictionary(spark)), {"increase": ["tha"], "detect": ["eri"]})

    out = TK.transfer_features(corpus(spark, sf), derive, ["increase", "detect"])
    return out.select("id", F.col("features")["increase"].alias("increase"),
                      F.col("features")["detect"].alias("detect"))


@register("feature_totals", CT + f"SELECT feature, {s6('sum(w)')} AS total FROM feats GROUP BY 1")
def feature_totals(spark, sf):
    """Sum of each feature over the corpus."""
    return TK.feature_totals(corpus(spark, sf)).select("feature", r6("total").alias("total"))


def _phr_sql():
    parts = " UNION ALL ".join(
        f"SELECT regexp_extract({ASCII_LOWER_SQL}, {Q.q(p)}, 0) AS w, {s!r} AS s FROM corpus" for p, s in PHRASE_PATTERNS)
    return CORPUS_ONLY + f"SELECT DISTINCT w, s FROM ({parts}) WHERE w <> ''"


@register("extract_phrases", _phr_sql())
def extract_phrases(spark, sf):
    """First match per document and pattern, distinct phrases with the
    pattern's score (on lower-cased ASCII text)."""
    c = corpus(spark, sf).select(_ascii_lower().alias("text"))
    return TK.extract_phrases(c, PHRASE_PATTERNS).select("w", "s").distinct()


@register("valence_mark", Q.with_(Q.CORPUS, Q.TOKS, Q.VALENCE) + """
SELECT w.id, w.pos - 1 AS pos, w.term, w.prev, v.y AS factor FROM words_prev w JOIN valence v ON v.x = w.prev""")
def valence_mark(spark, sf):
    """Tokens right after a shifter with the shifter's multiplier."""
    t = TK.valence_tokens(corpus(spark, sf), fx.valence(spark))
    return t.where(F.col("prev").isin([v[0] for v in fx.VALENCE_ROWS])).select("id", "pos", "term", "prev", "factor")


@register("nonblank_runs", CORPUS_ONLY + "SELECT id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n "
          "FROM corpus")
def nonblank_runs(spark, sf):
    """Document length as the number of non-blank runs."""
    return corpus(spark, sf).select("id", T.nonblank_runs("text").alias("n"))


@register("month_key", CORPUS_ONLY + "SELECT id, strftime(date, '%Y-%m') AS month_key, "
          "CAST(date_trunc('month', date) AS DATE) AS month_start FROM corpus")
def month_key(spark, sf):
    """``yyyy-MM`` and first day of the month."""
    c = corpus(spark, sf)
    return c.select("id", T.month_key("date").alias("month_key"), T.month_start("date").alias("month_start"))


@register("nth_word", """SELECT event_id, TRY_CAST(split_part(props, ' ', 2) AS INTEGER) AS k
FROM (SELECT event_id, regexp_replace(props, '[{}":]', '', 'g') AS props FROM events)""")
def nth_word(spark, sf):
    """The second word of a label string cast to a number (here the
    event ``props`` text with its JSON punctuation removed)."""
    ev = fx.table(spark, sf, "events").select("event_id", F.regexp_replace("props", r'[{}":]', "").alias("p"))
    return ev.select("event_id", T.nth_word("p", 2).alias("k"))
