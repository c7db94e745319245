"""Lexicon construction (O51–O56).  Lexicons are one long table
``(lexicon, x, y)``; several lexicons share it, told apart by ``lexicon``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_broadcast, inherit_bound


def lexicon_setup(lexicons: DataFrame, valence: DataFrame | None = None, do_split: bool = False) -> DataFrame:
    """Lower-case words, keep the first score per word and lexicon (input
    order is the column ``pos``), drop shifter words from the word lists, and
    with ``do_split`` make ``<lex>_POS`` / ``<lex>_NEG`` lexicons."""
    if "pos" not in lexicons.columns:
        raise ValueError("lexicons need a column pos with the order of their entries")
    src = lexicons
    lx = lexicons.withColumn("x", F.lower(F.trim(F.col("x"))))
    lx = lx.groupBy("lexicon", "x").agg(F.min_by("y", F.struct("pos", "y")).alias("y"))
    if valence is not None:
        shifters = inherit_bound(valence.select(F.lower(F.col("x")).alias("x")).distinct(), valence)
        lx = lx.join(bounded_broadcast(shifters), "x", "left_anti")
    lx = lx.select("lexicon", "x", F.col("y").cast("double").alias("y"))
    if do_split:
        lx = lx.where(F.col("y") != 0).withColumn(
            "lexicon", F.concat("lexicon", F.when(F.col("y") > 0, F.lit("_POS")).otherwise(F.lit("_NEG"))))
    # at most one row per input row
    return inherit_bound(lx, src)


def lexicon_custom(spark: SparkSession, entries: list[tuple[str, float]], phrases: DataFrame | None = None,
                   name: str = "myLexicon") -> DataFrame:
    """Hand-made entries plus mined phrases (O35 output ``(w, s, pattern)``).

    Mined phrases come first, in the order of their patterns, then the fixed
    entries; ``pos`` keeps that order for :func:`lexicon_setup`, at any
    partitioning.
    """
    fixed = spark.createDataFrame([(w, float(s), 1_000_000_000 + i) for i, (w, s) in enumerate(entries)],
                                  "x string, y double, pos long")
    parts = fixed
    if phrases is not None:
        mined = phrases.groupBy(F.col("w").alias("x"), F.col("s").alias("y")).agg(
            F.min("pattern").cast("long").alias("pos"))
        parts = mined.unionByName(fixed)
    return parts.select(F.lit(name).alias("lexicon"), "x", "y", "pos")


def lexicon_remove_words(lexicons: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """Remove a word list from every lexicon (broadcast left anti)."""
    if isinstance(words, DataFrame):
        wdf = words.select(F.col(words.columns[0]).alias("x")).distinct()
        return lexicons.join(bounded_broadcast(wdf), "x", "left_anti")
    return lexicons.where(~F.col("x").isin(list(words)))


def lexicon_merge(*lexicons: DataFrame) -> DataFrame:
    """Put several lexicon tables into one set (UNION ALL by name)."""
    out = lexicons[0]
    for lx in lexicons[1:]:
        out = out.unionByName(lx, allowMissingColumns=True)
    return out


def lexicon_membership(probes: DataFrame, lexicons: DataFrame, word_col: str = "word") -> DataFrame:
    """For every probe word and lexicon, is the word listed?

    Each probe carries the (small, driver-known) list of lexicon names as an
    array that is exploded in its own row, then one left join on (lexicon, x)
    answers all probes at once.
    """
    names = lexicon_names(lexicons)
    grid = probes.select(F.col(word_col).alias("word"),
                         F.explode(F.array(*[F.lit(n) for n in names])).alias("lexicon"))
    listed = lexicons.select("lexicon", F.col("x").alias("word"), F.lit(True).alias("_hit")).distinct()
    return grid.join(listed, ["lexicon", "word"], "left").select(
        "word", "lexicon", F.coalesce("_hit", F.lit(False)).alias("listed"))


def terms_not_in_lexicons(terms: DataFrame, lexicons: DataFrame, term_col: str = "term") -> DataFrame:
    """Terms (e.g. the top-n of O42) minus every lexicon word."""
    words = lexicons.select(F.col("x").alias(term_col)).distinct()
    return terms.join(bounded_broadcast(words), term_col, "left_anti")


def lexicon_names(lexicons: DataFrame) -> list[str]:
    """Distinct lexicon names, sorted (a handful of strings)."""
    return sorted(r[0] for r in lexicons.select("lexicon").distinct().collect())
