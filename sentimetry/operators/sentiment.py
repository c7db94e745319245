"""Document sentiment.

One pass over the text: every document becomes one array of units (words with
the multiplier of a preceding shifter, whole sentences, optional n-grams),
exploded in its own row, probed against the broadcast lexicon and folded back
per document by a partial + final hash aggregate.  Only tf-idf needs corpus
statistics: document frequencies of the *lexicon* units, a table no larger
than the lexicon.  Python never touches a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_SPLIT, split_tokens, text_clean
from ..session import bounded_broadcast, inherit_bound
from .lexicon import lexicon_names
from .tokens import ngram_units

HOWS = ("counts", "proportional", "tf-idf")
UNITS = ("word", "sentence")


def _check(how: str, units: tuple[str, ...], phrase_mode: str) -> None:
    if how not in HOWS:
        raise ValueError(f"Please select an appropriate aggregation 'how' (one of {HOWS}), not {how!r}")
    if not units or any(u not in UNITS for u in units):
        raise ValueError(f"units must be a non-empty subset of {UNITS}")
    if phrase_mode not in ("unit", "ngram"):
        raise ValueError("phrase_mode is 'unit' or 'ngram'")


def _phrase_lengths(lex: DataFrame) -> list[int]:
    """Word counts of multi-word lexicon entries (a handful of small ints)."""
    rows = lex.select(F.size(F.split("unit", " ")).alias("n")).where("n > 1").distinct().collect()
    return sorted(r[0] for r in rows)


def document_units(corpus: DataFrame, stopwords: list[str] | None = None, units: tuple[str, ...] = UNITS,
                   phrase_lengths: list[int] | None = None, clean: bool = True,
                   group_cols: list[str] | None = None) -> DataFrame:
    """Per document ``(id, date, word_count, _tok, _nw, _ns, u)``: ``u`` is one
    string array = the words, then the kept sentence units, then n-grams, all
    built inside the row with vectorised array functions.

    word_count = kept words + kept sentence units (the reference binds the two
    unit tables column-wise before taking row sums).
    """
    stop = list(stopwords or [])
    text = F.coalesce(F.col("text"), F.lit(""))  # a NULL text is an empty document
    ctext = text_clean(text) if clean else text
    g = list(group_cols or [])
    base = corpus.select(*g, "id", "date", ctext.alias("_ct")).select(
        *g, "id", "date", "_ct", split_tokens("_ct").alias("_tok"))
    empty = F.array().cast("array<string>")
    words = F.col("_tok") if "word" in units else empty
    n_stop = F.size(F.filter("_tok", lambda t: t.isin(stop))) if stop else F.lit(0)
    n_words = (F.size("_tok") - n_stop) if "word" in units else F.lit(0)
    if "sentence" in units:
        sents = F.transform(F.split("_ct", SENTENCE_SPLIT), lambda x: F.array_join(split_tokens(x), " "))
        sents = F.filter(sents, (lambda u: (u != "") & ~u.isin(stop)) if stop else (lambda u: u != ""))
    else:
        sents = empty
    parts = [words, sents] + [ngram_units("_tok", n) for n in (phrase_lengths or [])]
    out = base.select(*g, "id", "date", "_tok", words.alias("_w"), sents.alias("_s"), *[
        p.alias(f"_g{i}") for i, p in enumerate(parts[2:])])
    allu = F.concat("_w", "_s", *[f"_g{i}" for i in range(len(parts) - 2)])
    return out.select(*g, "id", "date", (n_words + F.size("_s")).cast("long").alias("word_count"), "_tok",
                      F.size("_w").alias("_nw"), F.size("_s").alias("_ns"), allu.alias("u"))


def score_documents(corpus: DataFrame, lexicons: DataFrame, valence: DataFrame | None = None,
                    stopwords: list[str] | None = None, how: str = "counts", units: tuple[str, ...] = UNITS,
                    phrase_mode: str = "unit", clean: bool = True, names: list[str] | None = None,
                    group_cols: list[str] | None = None) -> DataFrame:
    """One row per document and lexicon
    ``(id, date, features, word_count, lexicon, score)``.

    * counts:       s = Σ factor·y
    * proportional: s = Σ factor·y / word_count   (0 when word_count = 0)
    * tf-idf:       s = Σ factor·y·log10(N/df) / word_count

    ``lexicons`` is ``(lexicon, x, y)`` after :func:`lexicon_setup`.  With
    ``phrase_mode='unit'`` a multi-word entry only matches a whole sentence
    (the reference's behaviour); ``'ngram'`` also matches it anywhere.
    ``group_cols`` scores each group (e.g. an event's documents) as its own
    corpus: a document may sit in several groups and tf-idf statistics are
    taken per group.
    """
    g = list(group_cols or [])
    key = g + ["id"]
    _check(how, tuple(units), phrase_mode)
    lex = lexicons.select(F.col("x").alias("unit"), "lexicon", F.col("y").cast("double").alias("y"))
    names = names or lexicon_names(lex)
    plens = _phrase_lengths(lex) if phrase_mode == "ngram" else []
    docs = document_units(corpus, stopwords, tuple(units), plens, clean, g)
    ex = docs.select(*key, "date", "word_count", "_tok", "_nw", "_ns", F.posexplode_outer("u").alias("_p", "unit"))
    kind = (F.when(F.col("_p").isNull(), F.lit(None)).when(F.col("_p") < F.col("_nw"), F.lit("word"))
            .when(F.col("_p") < F.col("_nw") + F.col("_ns"), F.lit("sentence")).otherwise(F.lit("ngram")))
    stop = list(stopwords or [])
    # a stop word keeps its row (so a document of stop words only is still
    # scored, with 0) but loses its unit, so it matches no lexicon entry
    unit = (F.when((F.col("_p") < F.col("_nw")) & F.col("unit").isin(stop), F.lit(None)).otherwise(F.col("unit"))
            if stop else F.col("unit"))
    rows = ex.select(*key, "date", "word_count", "_p", unit.alias("unit"), kind.alias("kind"),
                     F.when((F.col("_p") > 0) & (F.col("_p") < F.col("_nw")),
                            F.element_at("_tok", F.col("_p"))).alias("prev"))
    if valence is not None:
        v = valence.select(F.lower(F.col("x")).alias("prev"), F.col("y").alias("_vy")).dropDuplicates(["prev"])
        rows = rows.join(bounded_broadcast(inherit_bound(v, valence)), "prev", "left")
        factor = F.when(F.col("kind") == "word", F.coalesce("_vy", F.lit(1.0))).otherwise(F.lit(1.0))
    else:
        factor = F.lit(1.0)
    # n-grams may only hit multi-word entries, so a word is never counted twice
    lex_b = bounded_broadcast(inherit_bound(lex, lexicons))
    hit = rows.join(lex_b, "unit", "left").where(
        (F.col("kind") != "ngram") | F.col("unit").contains(" ") | F.col("kind").isNull())
    # of units without an entry only a document's first goes on, which keeps the document
    hit = hit.where(F.col("lexicon").isNotNull() | F.coalesce(F.col("_p"), F.lit(0)).isin(0))
    contrib = factor * F.col("y")
    # date and word_count are per document, so they are grouping keys: the
    # aggregate stays a (codegen) hash aggregate; the feature map is joined
    # back afterwards from a scan that does not read the text
    keep = ["date", "word_count"]
    feats = corpus.select(*key, "features")
    if how in ("counts", "proportional"):
        per_doc = hit.groupBy(*key, *keep).agg(
            *[F.sum(F.when(F.col("lexicon") == n, contrib)).alias(f"_s{i}") for i, n in enumerate(names)])
        per_doc = per_doc.join(feats, key)
        score = (lambda c: F.coalesce(c, F.lit(0.0))) if how == "counts" else (
            lambda c: F.coalesce(F.try_divide(c, F.col("word_count")), F.lit(0.0)))
        stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("lexicon"), score(F.col(f"_s{i}")).alias("score"))
                                      for i, n in enumerate(names)]))
        return per_doc.select(*key, *keep, "features", stacked.alias("_p")).select(
            *key, *keep, "features", "_p.lexicon", "_p.score")
    # tf-idf: keep the matched units per document, then weight by idf
    per_doc = hit.groupBy(*key, *keep).agg(
        F.collect_list(F.when(F.col("lexicon").isNotNull(),
                              F.struct("kind", "unit", "lexicon", contrib.alias("c")))).alias("m"))
    dfreq = (per_doc.select(*key, F.explode(F.array_distinct(F.transform("m", lambda s: F.struct(
        s["kind"].alias("kind"), s["unit"].alias("unit"))))).alias("k"))
        .groupBy(*g, "k.kind", "k.unit").agg(F.count("*").alias("df")))
    if g:
        n_docs = corpus.groupBy(*g).agg(F.count("*").alias("_n"))
        idf = dfreq.join(n_docs, g).select(*g, "kind", "unit", F.log10(F.col("_n") / F.col("df")).alias("idf"))
        idf_side = idf  # groups × lexicon units: left to AQE
    else:
        # N from the corpus itself: a column-pruned count, not a second run
        # of the text pipeline
        n_docs = corpus.select(F.count("*")).scalar()
        idf = dfreq.select("kind", "unit", F.log10(n_docs / F.col("df")).alias("idf"))
        # one row per matched lexicon unit: hinted where the lexicon's size is known
        idf_side = bounded_broadcast(inherit_bound(idf, lexicons))
    # both branches read the same per-document aggregate (one text pass; the
    # stage is shared): documents without a match keep one row via
    # explode_outer and score 0
    matched = per_doc.select(*key, *keep, F.explode_outer("m").alias("s")).select(
        *key, *keep, "s.kind", "s.unit", "s.lexicon", "s.c")
    weighted = matched.join(idf_side, g + ["kind", "unit"], "left").groupBy(*key, *keep).agg(
        *[F.sum(F.when(F.col("lexicon") == n, F.col("c") * F.col("idf"))).alias(f"_s{i}")
          for i, n in enumerate(names)])
    out = weighted.join(feats, key)
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("lexicon"), F.coalesce(
        F.try_divide(F.col(f"_s{i}"), F.col("word_count")), F.lit(0.0)).alias("score"))
        for i, n in enumerate(names)]))
    return out.select(*key, *keep, "features", stacked.alias("_p")).select(
        *key, *keep, "features", "_p.lexicon", "_p.score")


def sentiment_by_feature(doc_scores: DataFrame) -> DataFrame:
    """Score × feature weight, one row per document, lexicon and feature
    ``(id, date, word_count, lexicon, feature, score)``."""
    rest = [c for c in doc_scores.columns if c not in ("features", "score")]
    return doc_scores.select(*rest, "score", F.explode("features").alias("feature", "w")).select(
        *rest, "feature", (F.col("score") * F.col("w")).alias("score"))


def document_sentiment(corpus: DataFrame, lexicons: DataFrame, valence: DataFrame | None = None,
                       stopwords: list[str] | None = None, how: str = "counts", units: tuple[str, ...] = UNITS,
                       phrase_mode: str = "unit", clean: bool = True, group_cols: list[str] | None = None) -> DataFrame:
    """``my_compute_sentiment`` as one plan: O57–O63 then O61."""
    return sentiment_by_feature(score_documents(corpus, lexicons, valence, stopwords, how, units, phrase_mode, clean,
                                                group_cols=group_cols))


DTM_COLUMNS = {"id", "term", "n"}


def score_dtm(dtm: DataFrame, lexicons: DataFrame, how: str = "counts", docs: DataFrame | None = None) -> DataFrame:
    """Score a ready-made document-term table ``(id, term, n)``.

    Returns ``(id, word_count, lexicon, score)`` for every document of ``docs``
    (id), those without a term included, or else of the table; a table of
    another shape is rejected like a non-dfm argument.
    """
    if not DTM_COLUMNS.issubset(set(dtm.columns)):
        raise ValueError("The 'dtm' argument should be a document-term table with columns id, term, n.")
    _check(how, UNITS, "unit")
    names = lexicon_names(lexicons)
    lex = bounded_broadcast(lexicons.select(F.col("x").alias("term"), "lexicon", "y"))
    d = dtm.select("id", "term", F.col("n").cast("double").alias("n"))
    wc = d.groupBy("id").agg(F.sum("n").alias("word_count"))
    if docs is not None:
        wc = docs.select("id").join(wc, "id", "left").select("id", F.coalesce("word_count", F.lit(0.0)).alias("word_count"))
    d = d.join(lex, "term")  # only lexicon terms go on, so what follows has their size
    if how == "tf-idf":
        n_docs = (docs if docs is not None else wc).select(F.count("*")).scalar()
        listed = dtm.where("n > 0").join(lexicons.select(F.col("x").alias("term")).distinct(), "term", "left_semi")
        dfreq = listed.groupBy("term").agg(F.count("*").alias("df"))
        d = d.join(dfreq, "term").withColumn("n", F.col("n") * F.log10(n_docs / F.col("df")))
    sums = d.groupBy("id").agg(
        *[F.sum(F.when(F.col("lexicon") == n, F.col("n") * F.col("y"))).alias(f"_s{i}")
          for i, n in enumerate(names)])
    out = wc.join(sums, "id", "left")
    if how == "counts":
        score = lambda c: F.coalesce(c, F.lit(0.0))
    else:
        score = lambda c: F.coalesce(F.try_divide(c, F.col("word_count")), F.lit(0.0))
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("lexicon"), score(F.col(f"_s{i}")).alias("score"))
                                  for i, n in enumerate(names)]))
    return out.select("id", "word_count", stacked.alias("_p")).select("id", "word_count", "_p.lexicon", "_p.score")
