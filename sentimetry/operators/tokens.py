"""Tokens and text-derived tables.

Tokenisation is row-local: a document is cleaned and split inside its own row,
so none of these steps shuffles.  Long token tables come from ``posexplode``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_SPLIT, drop_words, split_tokens, text_clean
from ..session import bounded_broadcast, row_bound


def tokens_array(df: DataFrame, text_col: str = "text", clean: bool = True, out: str = "tokens") -> DataFrame:
    """Add an ``array<string>`` of tokens (O22 cleaning, split, empties dropped)."""
    src = text_clean(text_col) if clean else F.col(text_col)
    return df.withColumn(out, split_tokens(src))


def word_tokens(df: DataFrame, id_col: str = "id", text_col: str = "text", stopwords: list[str] | None = None,
                clean: bool = True) -> DataFrame:
    """Long token table ``(id, pos, term)``; stop words removed after positions
    are assigned, so ``pos`` keeps the position in the full text."""
    t = tokens_array(df.select(id_col, text_col), text_col, clean)
    out = t.select(F.col(id_col).alias("id"), F.posexplode("tokens").alias("pos", "term"))
    if stopwords:
        out = out.where(~F.col("term").isin(list(stopwords)))
    return out


def sentence_units(df: DataFrame, id_col: str = "id", text_col: str = "text", clean: bool = True,
                   stopwords: list[str] | None = None) -> DataFrame:
    """One row per sentence ``(id, spos, unit)``; a unit is the sentence's
    cleaned tokens joined by one blank.  Sentences end at ``.``, ``!`` or ``?``
    followed by white space (no look-around, so RE2 can mirror it)."""
    parts = F.split(F.col(text_col), SENTENCE_SPLIT)
    units = F.transform(parts, lambda s: F.array_join(split_tokens(text_clean(s) if clean else s), " "))
    keep = F.filter(units, lambda u: u != "")
    if stopwords:
        keep = drop_words(keep, stopwords)
    return df.select(F.col(id_col).alias("id"), F.posexplode(keep).alias("spos", "unit"))


def valence_tokens(df: DataFrame, valence: DataFrame | None, id_col: str = "id", text_col: str = "text",
                   stopwords: list[str] | None = None, clean: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Tokens with the multiplier of a directly preceding shifter.

    ``factor`` is the shifter's ``y`` when the previous token (before stop-word
    removal) is a shifter, else 1.0; a chain only uses the nearest shifter.
    The previous token is read from the document's own token array, so no
    window and no shuffle is needed; the shifter list is a broadcast side.
    Columns in ``keep`` are carried along.
    """
    keep = keep or []
    t = tokens_array(df.select(id_col, text_col, *keep), text_col, clean)
    ex = t.select(F.col(id_col).alias("id"), *keep, "tokens", F.posexplode("tokens").alias("pos", "term"))
    ex = ex.withColumn("prev", F.when(F.col("pos") > 0, F.element_at("tokens", F.col("pos"))))
    if valence is not None:
        v = valence.select(F.lower(F.col("x")).alias("prev"), F.col("y").alias("vy")).dropDuplicates(["prev"])
        ex = ex.join(bounded_broadcast(v), "prev", "left").withColumn("factor", F.coalesce("vy", F.lit(1.0)))
    else:
        ex = ex.withColumn("factor", F.lit(1.0))
    if stopwords:
        ex = ex.where(~F.col("term").isin(list(stopwords)))
    return ex.select("id", *keep, "pos", "term", "prev", "factor")


def ngram_units(tokens_col, n: int):
    """Array of the n-grams of a token array, each joined by one blank."""
    arr = F.col(tokens_col) if isinstance(tokens_col, str) else tokens_col
    if n == 1:
        return arr
    # the n-gram starting at token i is tokens i..i+n-1 joined by blanks;
    # pairing the array with its shifted copies needs no per-position slice
    shifted = [F.slice(arr, k + 1, F.size(arr) - F.lit(n - 1)) for k in range(n)]
    zipped = F.arrays_zip(*shifted)
    grams = F.transform(zipped, lambda z: F.concat_ws(" ", *[z[str(k)] for k in range(n)]))
    return F.when(F.size(arr) >= n, grams).otherwise(F.array().cast("array<string>"))


DICTIONARY_BUCKETS = 1024
DICTIONARY_ROWS = 200_000  # proven rows up to which a dictionary comes as one value


def _bucket(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(DICTIONARY_BUCKETS)).cast("int")


def _one_lemma(dictionary: DataFrame) -> DataFrame:
    form, lemma = dictionary.columns[:2]
    return dictionary.where(F.col(form).isNotNull()).groupBy(F.col(form).alias("form")).agg(F.min(lemma).alias("lemma"))


def dictionary_row(dictionary: DataFrame) -> F.Column:
    """The dictionary (form, lemma) as one value: an array of small maps by hash
    of the form, so that a look-up inside a row scans a few entries only."""
    maps = _one_lemma(dictionary).groupBy(_bucket(F.col("form")).alias("b")).agg(F.collect_list(F.struct("form", "lemma")).alias("m"))
    every = dictionary.sparkSession.range(DICTIONARY_BUCKETS).select(F.col("id").cast("int").alias("b")).join(maps, "b", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: F.map_from_entries(x["m"]))).scalar()


def text_dictionaries(texts: DataFrame, dictionary: DataFrame, text_col: str) -> DataFrame:
    """(text_key, forms): for each text that has a form of the dictionary, these
    forms by bucket, each with its lemma.

    The distinct words of each text meet the dictionary by a join on the word, so
    neither is held whole anywhere; a word in very many texts has one row in the
    dictionary, and the join's other side can be split.  The key is the text's
    hash: texts that share one by chance share their forms, which are right for both.
    """
    key = F.xxhash64(text_col).alias("text_key")
    words = texts.where(F.col(text_col).isNotNull()).select(key, F.explode(F.array_distinct(F.split(F.col(text_col), " "))).alias("form")).distinct()
    found = words.join(_one_lemma(dictionary).where(F.col("lemma") != F.col("form")), "form")
    some = found.groupBy("text_key", _bucket(F.col("form")).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("m"))
    return some.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("forms"))


def lemmatize(df: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Replace each blank-separated token by its dictionary form.

    A dictionary of at most ``DICTIONARY_ROWS`` proven rows (a parameter table)
    comes as one value, and each document is folded in its own row: no text and
    no token is shuffled.  Any other dictionary is joined to the distinct words
    of the texts, and each text gets the entries it needs."""
    bound = row_bound(dictionary)
    if bound is not None and bound <= DICTIONARY_ROWS:
        with_forms = df.withColumn("_forms", dictionary_row(dictionary))
        forms = lambda t: F.try_element_at(F.get(F.col("_forms"), _bucket(t)), t)
    else:
        own = text_dictionaries(df, dictionary, text_col).withColumnRenamed("forms", "_forms").withColumnRenamed("text_key", "_text_key")
        with_forms = df.withColumn("_text_key", F.xxhash64(text_col)).join(own, "_text_key", "left").drop("_text_key")
        forms = lambda t: F.try_element_at(F.try_element_at(F.col("_forms"), _bucket(t)), t)
    folded = F.array_join(F.transform(F.split(F.col(text_col), " "), lambda t: F.coalesce(forms(t), t)), " ")
    return with_forms.withColumn(text_col, folded).drop("_forms")


def lemmatize_tokens(tokens: DataFrame, dictionary: DataFrame, term_col: str = "term") -> DataFrame:
    """O31 on a long token table: ``coalesce(lemma, term)`` via broadcast lookup."""
    d = dictionary.select(F.col(dictionary.columns[0]).alias(term_col), F.col(dictionary.columns[1]).alias("_lemma"))
    d = d.dropDuplicates([term_col])
    return tokens.join(bounded_broadcast(d), term_col, "left").withColumn(
        term_col, F.coalesce("_lemma", term_col)).drop("_lemma")


def extract_phrases(df: DataFrame, patterns: list[tuple[str, float]], text_col: str = "text") -> DataFrame:
    """First match per document and pattern, non-matches dropped,
    distinct ``(w, s)`` phrases with the pattern's score, and the number
    ``pattern`` of the pattern, in the order given.

    The pattern list is a parameter expanded into one ``regexp_extract`` per
    pattern in a single projection; ``distinct`` aggregates partially first.
    """
    for p, _ in patterns:
        re.compile(p)
    hits = F.array(*[
        F.struct(F.regexp_extract(F.col(text_col), p, 0).alias("w"), F.lit(float(s)).alias("s"),
                 F.lit(i).alias("pattern")) for i, (p, s) in enumerate(patterns)])
    return (df.select(F.explode(hits).alias("h")).select("h.w", "h.s", "h.pattern")
            .where(F.col("w") != "").distinct())


def keyword_features(corpus: DataFrame, keywords: dict[str, list[str]], text_col: str = "text",
                     whole_word: bool = False) -> DataFrame:
    """One 0/1 feature per keyword list: 1 when any keyword occurs in the
    text (substring match by default, as the reference; ``whole_word`` spells
    the boundary out with letters so it means the same on any text)."""
    entries = []
    for name, words in keywords.items():
        alt = "|".join(re.escape(w) for w in words)
        pat = f"(^|[^\\p{{L}}])({alt})([^\\p{{L}}]|$)" if whole_word else f"({alt})"
        entries += [F.lit(name), F.col(text_col).rlike(pat).cast("double")]
    new = F.create_map(*entries)
    return corpus.withColumn("features", F.map_concat(F.col("features"), new))


def transfer_features(corpus: DataFrame, derive, names: list[str]) -> DataFrame:
    """Features computed on a derived corpus, attached to the original.

    ``derive`` is a row-local DataFrame → DataFrame step (say lemmatise, then
    keyword features) that rewrites ``text`` and ``features``; it runs on a copy
    of both inside the row, so nothing is joined or shuffled.
    """
    own = corpus.withColumn("_own", F.struct("text", "features")).withColumn(
        "features", F.create_map().cast("map<string,double>"))
    out = derive(own)
    return out.withColumn("features", F.map_concat(
        F.map_filter("_own.features", lambda k, v: ~k.isin(names)),
        F.map_filter("features", lambda k, v: k.isin(names)))).withColumn("text", F.col("_own.text")).drop("_own")


def feature_totals(corpus: DataFrame) -> DataFrame:
    """Sum of each feature over the corpus ``(feature, total)``."""
    return (corpus.select(F.explode("features").alias("feature", "v"))
            .groupBy("feature").agg(F.sum("v").alias("total")))


def feature_names(corpus: DataFrame) -> DataFrame:
    """The dynamic feature set."""
    return corpus.select(F.explode(F.map_keys("features")).alias("feature")).distinct()
