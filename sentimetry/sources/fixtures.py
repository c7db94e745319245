"""Stand-in inputs built from the driver's read-only tables (FIXTURES.md).

Every builder reads the given parquet tables, or returns a small fixed table
(lexicons, shifters, stop words, timeline, coefficients) that is only ever
joined to data derived from those tables.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import mark_bounded
from .corpus import corpus_from_table

# ---------------------------------------------------------------------------
# Fixed values of the test fixtures (FIXTURES.md §2).  They are parameters of
# the tests, chosen to occur in the invented English prose.
# ---------------------------------------------------------------------------
LEXICON_ROWS = [
    # (lexicon, word or phrase, score), in input order; order decides which of
    # two duplicate entries of one lexicon is kept (the first).
    ("LEXA", "than", 1.0), ("LEXA", "thed", -1.0), ("LEXA", "thor", 2.0), ("LEXA", "thin", -1.0),
    ("LEXA", "thea", 1.0), ("LEXA", "thes", -2.0), ("LEXA", "erin", 1.5),
    ("LEXB", "thou", 1.0), ("LEXB", "thing", -1.0), ("LEXB", "erre", -1.0), ("LEXB", "ble", 1.0),
    ("LEXB", "thth", -2.0), ("LEXB", "than", -1.0), ("LEXB", "erst", 1.0),
    ("LEXC", "eron", -1.0), ("LEXC", "orre", 1.0), ("LEXC", "rewh", 1.0), ("LEXC", "thatin", -1.0),
    ("LEXC", "resh", 2.0),
    ("MINE", "anea eriner", 2.0), ("MINE", "eriner thanea", -1.0), ("MINE", "onre enat", 1.0),
    ("MINE", "esndha reedes", -2.0), ("MINE", "than", 3.0), ("MINE", "than", -3.0),
]
VALENCE_ROWS = [("the", 1, -1.0), ("of", 2, 2.0), ("and", 3, 0.5)]
STOPWORDS = [
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by",
    "as", "this", "are", "at", "from", "www", "https", "http", "httpwww",
]
TIMELINE_ROWS = [
    ("E1", "1995-06-01"), ("E2", "1996-11-20"), ("E3", "1998-02-14"), ("E4", "1999-09-09"),
    ("E5", "2000-12-31"), ("E6", "1997-03-02"), ("E7", "1997-03-28"),
]
DICTIONARY_ROWS = [("thing", "thin"), ("than", "tha"), ("thes", "the"), ("erin", "eri")]
COEF_INTERCEPT = -0.25
COEF_ROWS = [
    ("LEXA--press--equal_weight", 1.5), ("LEXA--news--linear", -0.75),
    ("LEXB--press--equal_weight", 2.0), ("LEXC--other--linear", 0.0),
]
FEATURE_NAMES = ["press", "web", "news", "products", "results", "other"]

LEXICON_SCHEMA = T.StructType([
    T.StructField("lexicon", T.StringType(), False),
    T.StructField("x", T.StringType(), False),
    T.StructField("y", T.DoubleType(), False),
])
VALENCE_SCHEMA = T.StructType([
    T.StructField("x", T.StringType(), False),
    T.StructField("t", T.IntegerType(), False),
    T.StructField("y", T.DoubleType(), False),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dated corpus ``(id, date, text, features MAP<STRING,DOUBLE>)``."""
    docs = table(spark, sf_dir, "documents")
    src = F.regexp_extract("source", r"^src(\d+)$", 1).cast("long")
    lang_en = (F.col("lang") == "en").cast("double")
    press = (src % 3 == 0).cast("double")
    features = F.create_map(
        F.lit("press"), press,
        F.lit("web"), (src % 3 == 1).cast("double"),
        F.lit("news"), (F.col("doc_id") % 10) / F.lit(9.0),
        F.lit("products"), lang_en,
        F.lit("results"), (F.col("n_chars") > 2000).cast("double"),
        F.lit("other"), F.lit(1.0) - press,
    )
    base = docs.select(
        F.col("doc_id").alias("id"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("doc_id") * 41) % 2405).cast("int")).alias("date"),
        "text",
        features.alias("features"),
    )
    return corpus_from_table(base)


def lexicons(spark: SparkSession) -> DataFrame:
    """F2 with input order kept in ``pos`` (first entry wins on duplicates)."""
    rows = [(lex, x, y, i) for i, (lex, x, y) in enumerate(LEXICON_ROWS)]
    return mark_bounded(spark.createDataFrame(rows, "lexicon string, x string, y double, pos int"), len(rows))


def valence(spark: SparkSession) -> DataFrame:
    return mark_bounded(spark.createDataFrame(VALENCE_ROWS, VALENCE_SCHEMA), len(VALENCE_ROWS))


def default_stopwords(spark: SparkSession, extra: tuple[str, ...] = ("www", "https", "http", "httpwww")) -> DataFrame:
    """Spark's English stop list with the given tokens appended."""
    words = list(dict.fromkeys([*StopWordsRemover.loadDefaultStopWords("english"), *extra]))
    return mark_bounded(spark.createDataFrame([(w,) for w in words], "term string"), len(words))


def stopwords(spark: SparkSession) -> DataFrame:
    return mark_bounded(spark.createDataFrame([(w,) for w in STOPWORDS], "term string"), len(STOPWORDS))


def timeline(spark: SparkSession) -> DataFrame:
    return mark_bounded(spark.createDataFrame(TIMELINE_ROWS, "event string, date string").select(
        "event", F.col("date").cast("date").alias("date")), len(TIMELINE_ROWS))


def dictionary(spark: SparkSession) -> DataFrame:
    return mark_bounded(spark.createDataFrame(DICTIONARY_ROWS, "form string, lemma string"), len(DICTIONARY_ROWS))


def coefficients(spark: SparkSession) -> DataFrame:
    return mark_bounded(spark.createDataFrame(COEF_ROWS, "measure string, beta double"), len(COEF_ROWS))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily series ``(date, volume)`` from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("volume"))


def market_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("volume"))


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: ``(doc_id, topic, theta)``: one topic for each embedding value."""
    e = table(spark, sf_dir, "embeddings")
    vals = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    tot = F.aggregate(vals, F.lit(0.0), lambda acc, v: acc + v)
    return (
        e.select(F.col("vec_id").alias("doc_id"), vals.alias("v"), tot.alias("tot"))
        .select("doc_id", "tot", F.posexplode("v").alias("p", "a"))
        .select("doc_id", (F.col("p") + 1).alias("topic"), (F.col("a") / F.col("tot")).alias("theta"))
    )


def category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("category"))


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, label, x1, x2, x3)`` from labels joined to documents."""
    lab = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").cast("int").alias("label"),
        F.col("toxic").cast("double").alias("x1"),
        (F.col("lang") == "en").cast("double").alias("x2"),
        (F.col("toxic").cast("double") * (F.col("lang") == "en").cast("double")).alias("x3"),
    )
