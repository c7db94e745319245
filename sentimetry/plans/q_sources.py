"""Registered queries: sources and sinks."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..operators.measures import aggregate_documents
from ..operators.sentiment import document_sentiment
from ..operators.tokens import word_tokens
from ..sources import corpus as C
from ..sources import fixtures as fx
from ..sources import sinks as K
from ..session import bounded_broadcast, inherit_bound
from . import sql as Q
from .common import corpus, lexicons, r6, s6
from .registry import register

PRE = [Q.CORPUS, Q.FEATS, Q.TOKS, Q.LEXICON, Q.VALENCE, Q.LEX_SETUP]
FEATURE_SQL = ", ".join(
    f"max(CASE WHEN f.feature = {Q.q(n)} THEN f.w END) AS {n}" for n in fx.FEATURE_NAMES)


@register("corpus_scan", Q.with_(Q.CORPUS, Q.FEATS) + f"""SELECT c.id, c.date, c.text, {FEATURE_SQL}
FROM corpus c JOIN feats f ON f.id = c.id GROUP BY c.id, c.date, c.text""")
def corpus_scan(spark, sf):
    """The corpus with its feature map spelled out as columns."""
    c = corpus(spark, sf)
    return c.select("id", "date", "text", *[r6(F.col("features")[n]).alias(n) for n in fx.FEATURE_NAMES])


@register("lexicon_scan", Q.with_(Q.CORPUS, Q.TOKS, Q.LEXICON) + f"""
SELECT l.lexicon, l.x, l.y, count(DISTINCT w.id) AS n_docs FROM lex_raw l
LEFT JOIN words_all w ON w.term = l.x WHERE l.lexicon IN ('LEXA', 'LEXC') GROUP BY 1, 2, 3""")
def lexicon_scan(spark, sf):
    """Choose lexicons by name; each entry with the number of
    documents whose tokens contain it."""
    own = fx.lexicons(spark)
    lx = own.where(F.col("lexicon").isin("LEXA", "LEXC"))
    listed = bounded_broadcast(inherit_bound(lx.select("x").distinct(), own))
    toks = word_tokens(corpus(spark, sf)).select("id", F.col("term").alias("x"))
    toks = toks.join(listed, "x", "left_semi").distinct()  # only listed words are shuffled
    return (lx.join(toks, "x", "left").groupBy("lexicon", "x", "y")
            .agg(F.countDistinct("id").alias("n_docs")))


@register("valence_scan", Q.with_(Q.CORPUS, Q.TOKS, Q.VALENCE) + """
SELECT v.x, v.t, v.y, count(w.id) AS n_shifted FROM valence v
LEFT JOIN words_prev w ON w.prev = v.x GROUP BY 1, 2, 3""")
def valence_scan(spark, sf):
    """The shifter list with how many tokens each one shifts."""
    from ..operators.tokens import valence_tokens
    v = fx.valence(spark)
    t = valence_tokens(corpus(spark, sf), v)
    shifted = t.where(F.col("prev").isNotNull()).groupBy(F.col("prev").alias("x")).agg(F.count("*").alias("n"))
    return v.join(shifted, "x", "left").select("x", "t", "y", F.coalesce("n", F.lit(0)).alias("n_shifted"))


@register("stopword_list", Q.with_(Q.CORPUS, Q.TOKS) + f"""
SELECT s.term, count(w.id) AS n_removed FROM (SELECT * FROM {Q.values([(w,) for w in fx.STOPWORDS], ['term'])}) s
LEFT JOIN words_all w ON w.term = s.term GROUP BY 1""")
def stopword_list(spark, sf):
    """The stop list and how many tokens each entry removes."""
    sw = fx.stopwords(spark)
    toks = word_tokens(corpus(spark, sf)).groupBy("term").agg(F.count("*").alias("n"))
    return sw.join(toks, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n_removed"))


@register("timeline_table", Q.with_(Q.CORPUS, Q.TIMELINE) + """
SELECT t.event, t.date, count(c.id) AS n_docs FROM timeline t
LEFT JOIN corpus c ON strftime(c.date, '%Y-%m') = strftime(t.date, '%Y-%m') GROUP BY 1, 2""")
def timeline_table(spark, sf):
    """The event table with the number of documents in each event's month."""
    tl = fx.timeline(spark)
    docs = corpus(spark, sf).groupBy(F.date_format("date", "yyyy-MM").alias("mk")).agg(F.count("*").alias("n"))
    return (tl.withColumn("mk", F.date_format("date", "yyyy-MM")).join(docs, "mk", "left")
            .select("event", "date", F.coalesce("n", F.lit(0)).alias("n_docs")))


@register("market_scan", """SELECT CAST(o_orderdate AS DATE) AS date, """ + s6("sum(o_totalprice)") +
          """ AS volume, count(*) AS n FROM orders GROUP BY 1""")
def market_scan(spark, sf):
    """The daily market series (date, volume) read from parquet."""
    return (fx.market(spark, sf).groupBy("date")
            .agg(r6(F.sum("volume")).alias("volume"), F.count("*").alias("n")))


@register("result_sink", Q.with_(*PRE)[:-1] + ",\n" + Q.doc_sentiment_sql("counts") + ",\n" +
          Q.agg_docs_sql("month", "equal_weight", True) +
          f"\nSELECT date, lexicon, feature, {s6('value')} AS value FROM per_period")
def result_sink(spark, sf):
    """Monthly sentiment written as parquet partitioned by lexicon into
    the session's checkpoint folder, then read back."""
    per = aggregate_documents(document_sentiment(corpus(spark, sf), lexicons(spark), fx.valence(spark),
                                                 fx.STOPWORDS, "counts"), "month")
    back = K.write_and_read(spark, per, "per_period", partition_by=["lexicon"])
    return back.select("date", "lexicon", "feature", r6("value").alias("value"))


@register("topic_json_sink", None)
def topic_json_sink(spark, sf):
    """The topic browser's tables as JSON lines, one row each: φ, topic
    shares, term relevance, topic distances and the token table (rows-only)."""
    from ..operators import topics as TP
    from ..session import materialize
    from .q_topics import phi_counts, phi_standin
    cnt = phi_counts(spark, sf)
    phi = materialize(phi_standin(spark, sf, cnt), "phi")
    total = cnt.select(F.sum("n")).scalar()
    share = cnt.groupBy(F.col("lang").alias("topic")).agg((F.sum("n") / total).alias("share"))
    freq = cnt.groupBy("term").agg(F.sum("n").alias("freq"))
    tables = {"phi": phi, "share": share, "relevance": TP.topic_term_relevance(phi, freq, [0.0, 0.5, 1.0], 30),
              "distance": TP.topic_distance(phi), "token": TP.topic_token_table(phi, share)}
    rows = [t.select(F.lit(k).alias("kind"), F.to_json(F.struct("*")).alias("row")) for k, t in tables.items()]
    return K.write_json_and_read(spark, functools.reduce(lambda a, b: a.unionByName(b), rows), "topic_browser")


@register("distinct_dates_peek", Q.with_(Q.CORPUS) + "SELECT DISTINCT date FROM corpus ORDER BY date LIMIT 6")
def distinct_dates_peek(spark, sf):
    """The first six distinct dates."""
    return C.distinct_dates_peek(corpus(spark, sf), 6)

