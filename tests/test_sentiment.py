"""Document scoring on hand-written rows (FIXTURES.md §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentimetry.functions import text as T
from sentimetry.operators import lexicon as L
from sentimetry.operators import tokens as TK
from sentimetry.operators import sentiment as S
from sentimetry.sources import fixtures as fx
from sentimetry.sources.corpus import corpus_from_table

D = dt.date(2020, 1, 1)
ROWS = {
    1: "",
    2: "the of and",
    3: "than",
    4: "'than",
    5: "company's",
    6: "not the than",
    7: "than than. thed!",
    8: "Élan than 42 co+op",
    9: None,
}


def _corpus(spark, rows=ROWS):
    data = [(i, D, t, 1.0) for i, t in rows.items()]
    df = spark.createDataFrame(data, "id long, date date, text string, f double")
    return corpus_from_table(df)


def _lex(spark):
    return L.lexicon_setup(fx.lexicons(spark), fx.valence(spark))


def _scores(spark, how="counts", **kw):
    out = S.score_documents(_corpus(spark), _lex(spark), fx.valence(spark), fx.STOPWORDS, how, **kw)
    return {(r["id"], r["lexicon"]): (r["word_count"], r["score"]) for r in out.collect()}


def test_clean_text(spark):
    rows = spark.createDataFrame([(t,) for t in ["'than", "company's", "Élan than 42 co+op", "it's here"]], "t string")
    got = [r[0] for r in rows.select(T.text_clean("t")).collect()]
    assert got == [" than", "company ", "élan than    co+op", "it s here"]


def test_lexicon_setup_first_entry_wins_and_shifters_dropped(spark):
    lx = spark.createDataFrame([("A", "Than", 3.0, 0), ("A", "than", -3.0, 1), ("A", "the", 1.0, 2)],
                               "lexicon string, x string, y double, pos int")
    out = {(r["lexicon"], r["x"]): r["y"] for r in L.lexicon_setup(lx, fx.valence(spark)).collect()}
    assert out == {("A", "than"): 3.0}


@pytest.mark.parametrize("parts", [1, 5])
def test_phrase_of_two_patterns_keeps_the_first_score(spark, parts):
    """Pattern order decides, at any partitioning."""
    texts = spark.createDataFrame([(t,) for t in ["rise risk", "so rise risk", "zz", "aa risk"]], "text string")
    mined = TK.extract_phrases(texts.repartition(parts), [("aa risk", 5.0), ("rise [a-z]+", -3.0), ("[a-z]+e risk", 2.0)])
    lx = L.lexicon_custom(spark, [("aa risk", 9.0), ("must", -2.0)], mined)
    out = {r["x"]: r["y"] for r in L.lexicon_setup(lx.repartition(parts)).collect()}
    assert out == {"rise risk": -3.0, "aa risk": 5.0, "must": -2.0}
    with pytest.raises(ValueError):
        L.lexicon_setup(lx.drop("pos"))


def test_lexicon_split(spark):
    lx = spark.createDataFrame([("A", "good", 1.0, 0), ("A", "bad", -2.0, 1)],
                               "lexicon string, x string, y double, pos int")
    out = {(r["lexicon"], r["x"]) for r in L.lexicon_setup(lx, do_split=True).collect()}
    assert out == {("A_POS", "good"), ("A_NEG", "bad")}


def test_counts_hand_rows(spark):
    s = _scores(spark)
    # empty and NULL documents: nothing, score 0
    assert s[(1, "LEXA")] == (0, 0.0)
    assert s[(9, "LEXA")] == (0, 0.0)
    # stop words only: no word is kept, but the sentence unit is
    assert s[(2, "LEXA")] == (1, 0.0)
    # one-word document: counted as word and as sentence (the reference's cbind)
    assert s[(3, "LEXA")] == (2, 2.0)
    assert s[(3, "LEXB")] == (2, -2.0)
    assert s[(3, "MINE")] == (2, 6.0)  # first of the duplicate entries (3, not -3)
    assert s[(3, "LEXC")] == (2, 0.0)
    assert s[(4, "LEXA")] == (2, 2.0)  # leading quote removed
    assert s[(5, "LEXA")] == (2, 0.0)  # final possessive removed
    # 'the' is a shifter (-1) and a stop word: applied before removal
    assert s[(6, "LEXA")] == (3, -1.0)
    assert s[(6, "MINE")] == (3, -3.0)
    assert s[(7, "LEXA")] == (4, 1.0)
    assert s[(8, "LEXA")] == (5, 1.0)


def test_proportional_and_tfidf(spark):
    p = _scores(spark, "proportional")
    assert p[(3, "LEXA")] == (2, pytest.approx(1.0))
    assert p[(1, "LEXA")] == (0, 0.0)
    t = _scores(spark, "tf-idf")
    # 'than' as a word occurs in docs 3, 4, 6, 7, 8 of 9; as a sentence in 3, 4
    import math
    w_idf, s_idf = math.log10(9 / 5), math.log10(9 / 2)
    assert t[(3, "LEXA")][1] == pytest.approx((w_idf + s_idf) / 2)
    assert t[(6, "LEXA")][1] == pytest.approx(-w_idf / 3)


def test_phrase_modes(spark):
    rows = {1: "anea eriner x", 2: "anea eriner"}
    lex = _lex(spark)
    unit = {(r["id"], r["lexicon"]): r["score"] for r in S.score_documents(
        _corpus(spark, rows), lex, None, None, "counts").collect()}
    ngram = {(r["id"], r["lexicon"]): r["score"] for r in S.score_documents(
        _corpus(spark, rows), lex, None, None, "counts", units=("word",), phrase_mode="ngram").collect()}
    assert unit[(1, "MINE")] == 0.0 and unit[(2, "MINE")] == 2.0  # whole sentence only
    assert ngram[(1, "MINE")] == 2.0 and ngram[(2, "MINE")] == 2.0


def test_by_feature(spark):
    df = spark.createDataFrame([(1, D, "than", 0.5, 1.0)], "id long, date date, text string, a double, b double")
    out = S.document_sentiment(corpus_from_table(df), _lex(spark), None, None, "counts")
    got = {(r["lexicon"], r["feature"]): r["score"] for r in out.collect()}
    assert got[("LEXA", "a")] == 1.0 and got[("LEXA", "b")] == 2.0


def test_errors(spark):
    with pytest.raises(ValueError):
        S.score_documents(_corpus(spark), _lex(spark), how="bogus")
    with pytest.raises(ValueError):
        S.score_dtm(spark.createDataFrame([(1, "a")], "id long, word string"), _lex(spark))


def test_score_dtm(spark):
    dtm = spark.createDataFrame([(1, "than", 2), (1, "zzz", 2), (2, "thor", 1)], "id long, term string, n long")
    out = {(r["id"], r["lexicon"]): r["score"] for r in S.score_dtm(dtm, _lex(spark), "proportional").collect()}
    assert out[(1, "LEXA")] == pytest.approx(0.5)
    assert out[(2, "LEXA")] == pytest.approx(2.0)
    assert out[(2, "LEXB")] == 0.0


def test_valence_tokens(spark):
    from sentimetry.operators.tokens import valence_tokens
    c = _corpus(spark, {1: "of than and thor"})
    got = [(r["term"], r["factor"]) for r in valence_tokens(c, fx.valence(spark)).orderBy("pos").collect()]
    assert got == [("of", 1.0), ("than", 2.0), ("and", 1.0), ("thor", 0.5)]


def test_keyword_features_substring(spark):
    from sentimetry.operators.tokens import keyword_features
    c = _corpus(spark, {1: "the network", 2: "nothing"})
    out = {r["id"]: r["features"]["kw"] for r in keyword_features(c, {"kw": ["net"]}).collect()}
    assert out == {1: 1.0, 2: 0.0}
    out = {r["id"]: r["features"]["kw"] for r in keyword_features(c, {"kw": ["net"]}, whole_word=True).collect()}
    assert out == {1: 0.0, 2: 0.0}


def test_stream_scores_match_batch(spark, tmpdir_path):
    import shutil
    from sentimetry.streaming.scoring import score_stream
    src = f"{tmpdir_path}/in"
    import os
    os.makedirs(src)
    shutil.copy("/root/testdata/sf0.001/documents.parquet", f"{src}/part-0.parquet")

    def to_corpus(b):
        return b.select(F.col("doc_id").alias("id"), F.lit("2020-01-01").cast("date").alias("date"), "text",
                        F.lit(1.0).alias("all"))

    q = score_stream(spark, src, to_corpus, _lex(spark), f"{tmpdir_path}/out", f"{tmpdir_path}/ck",
                     fx.valence(spark), fx.STOPWORDS, "counts")
    q.awaitTermination(300)
    streamed = spark.read.parquet(f"{tmpdir_path}/out")
    batch = S.document_sentiment(corpus_from_table(to_corpus(spark.read.parquet(src))), _lex(spark),
                                 fx.valence(spark), fx.STOPWORDS, "counts")
    a = {(r["id"], r["lexicon"]): round(r["score"], 9) for r in streamed.collect()}
    b = {(r["id"], r["lexicon"]): round(r["score"], 9) for r in batch.collect()}
    assert a == b and len(a) == 4 * 200


def test_lemmatize_with_any_dictionary(spark):
    """A dictionary without a proven bound is joined, with the same results as the one held as a value."""
    from sentimetry.operators import tokens as TK
    from sentimetry.session import mark_bounded
    docs = spark.createDataFrame([(1, "cats ran  home", 1), (1, "cats ran  home", 2), (2, "", 3), (3, None, 4), (4, "w" + " cats" * 3000, 5), (None, "a b", 6), (5, "mice", 7)], "id long, text string, form int")
    forms = spark.createDataFrame([("cats", "cat"), ("cats", "zat"), ("ran", "run"), ("mice", "mouse"), ("home", "home"), (None, "x"), ("b", None)], "f string, l string")
    want = [(1, "cat run  home", 1), (1, "cat run  home", 2), (2, "", 3), (3, None, 4), (4, "w" + " cat" * 3000, 5), (None, "a b", 6), (5, "mouse", 7)]
    joined = TK.lemmatize(docs, forms)
    assert sorted(map(tuple, joined.collect()), key=lambda r: r[2]) == want and joined.columns == docs.columns
    bounded = mark_bounded(forms.select("*"), 7)
    assert sorted(map(tuple, TK.lemmatize(docs, bounded).collect()), key=lambda r: r[2]) == want
    assert TK.lemmatize(docs.where("false"), forms).collect() == []
    assert sorted(map(tuple, TK.lemmatize(docs, forms.where("false")).collect()), key=lambda r: r[2]) == sorted(map(tuple, docs.collect()), key=lambda r: r[2])


def test_tfidf_rows_before_the_fold(spark):
    """Units without an entry don't reach the fold by document, documents without a match do."""
    import math
    corpus = spark.createDataFrame([(1, "good plain plain plain good", {"f": 1.0}), (2, "plain plain", {"f": 1.0}), (3, None, {"f": 1.0})],
                                   "id long, text string, features map<string,double>").withColumn("date", F.lit("2020-01-01").cast("date"))
    lex = spark.createDataFrame([("L", "good", 1.0)], "lexicon string, x string, y double")
    out = S.score_documents(corpus, lex, None, None, "tf-idf", ("word",), names=["L"])
    got = {r["id"]: r["score"] for r in out.collect()}
    assert got == pytest.approx({1: 2 * math.log10(3) / 5, 2: 0.0, 3: 0.0})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    fold = plan[plan.index("collect_list"):]
    assert "isnotnull(lexicon" in fold[: fold.index("Generate")]


def test_dtm_is_counted_where_the_texts_lie(spark, monkeypatch):
    """No shuffle of counts; both ways of joining a DTM with terms agree."""
    from sentimetry.operators import dtm as D
    corpus = spark.createDataFrame([(i, f"aaa bbb w{'xyz'[i % 3] * 3} aaa {'q' * (i % 5 + 3)}") for i in range(40)] + [(7, "aaa ccc")], "id long, text string")
    for dtm in (D.dtm_build(corpus), D.dtm_build(corpus, with_len=True), D.topic_dtm(corpus)):
        plan = dtm._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan
    assert D.dtm_build(corpus).where("id = 7 AND term = 'aaa'").first()["n"] == 3  # rows of one id count together
    dtm = D.topic_dtm(corpus, with_len=True)
    got = []
    for rows in (10**6, 0):
        monkeypatch.setattr(D, "JOIN_ROWS", rows)
        tables = D.tfidf_docs(dtm), D.prune_by_tfidf(dtm), D.prune_sparse_terms(dtm, 0.8)
        got.append([sorted(map(tuple, t.collect())) for t in tables])
        assert all(("BroadcastHashJoin" if rows else "ShuffledHashJoin") in t._jdf.queryExecution().executedPlan().toString() for t in tables)
    assert got[0] == got[1] and all(got[0])


def test_dtm_tokens_of_an_id_are_counted_in_slices(spark, monkeypatch):
    """Rows of one id share their counts and length, over batches and slices; no task keeps its (id, term)."""
    import pyarrow as pa

    from sentimetry.operators import dtm as D

    corpus = spark.createDataFrame([(7, "aaa bbb aaa"), (7, "aaa ccc"), (8, None), (9, ""), (10, "bbb")], "id long, text string")
    for dtm in (D.dtm_build(corpus, with_len=True), D.topic_dtm(corpus, with_len=True)):
        assert sorted(tuple(r) for r in dtm.select("id", "doc_len", "term", "n").collect()) == [
            (7, 5, "aaa", 3), (7, 5, "bbb", 1), (7, 5, "ccc", 1), (10, 1, "bbb", 1)]
        assert "HashAggregate" not in dtm._jdf.queryExecution().executedPlan().toString()
    rows = [(None, ["x"]), (1, ["a", "b"]), (1, None), (1, ["a"]), (2, []), (3, ["a", "ü"]), (3, ["ü"]), (4, ["b"] * 3)]
    expected = [(None, 1, "x", 1), (1, 3, "a", 2), (1, 3, "b", 1), (3, 3, "a", 1), (3, 3, "ü", 2), (4, 3, "b", 3)]
    for tokens in (1, 3, 1 << 20):
        monkeypatch.setattr(D, "SLICE_TOKENS", tokens)
        for at in range(1, len(rows) + 1):
            batches = [pa.record_batch([pa.array([x[0] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.list_(pa.string()))], names=["id", "w"])
                       for some in (rows[i : i + at] for i in range(0, len(rows), at))]
            found = [(r["id"], r["doc_len"], c["term"], c["n"]) for b in D._term_counts(iter(batches)) for r in b.to_pylist() for c in r["cells"]]
            assert sorted(found, key=str) == sorted(expected, key=str)


def test_dtm_words_are_cleaned_once_a_different_word(spark, monkeypatch):
    """Words of a slice equal those of the column chain, word by word; the plan has no function over words."""
    import pyarrow as pa

    from sentimetry.functions import text as T
    from sentimetry.operators import dtm as D
    from sentimetry.operators import tokens as TK

    texts = ["the the1 abc ab1c 12 a1", "  x\ty+z  Über über's", "", None, "a\nb\vcd the end ab3c", "the", "ab\t\r\n cd1ef abc"]
    corpus = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "id long, text string")
    stop = ["the", "a", "abc"]
    chain = T.collapse_whitespace(T.text_lower(T.strip_punctuation(T.text_to_ascii("text"))))
    topic = F.transform(T.drop_words(F.split(chain, " "), stop), T.remove_numbers)
    for most in (1, 4, 1 << 20):
        monkeypatch.setattr(D, "SLICE_TOKENS", most)
        for got, words in ((D.dtm_build(corpus, stop), T.drop_words(F.col("tokens"), stop)), (D.dtm_build(corpus, clean=False), F.col("raw")),
                           (D.topic_dtm(corpus, stop, 0), topic), (D.topic_dtm(corpus, None, 3), F.filter(F.transform(F.split(chain, " "), T.remove_numbers), lambda w: F.length(w) >= 3))):
            both = TK.tokens_array(TK.tokens_array(corpus), clean=False, out="raw")
            plain = both.select("id", F.explode(words).alias("term")).groupBy("id", "term").count()
            assert sorted(map(tuple, got.select("id", "term", "n").collect())) == sorted(map(tuple, plain.collect()))
        batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["id", "w"])
        sizes = [sum(len(w) for w in b.column("w").to_pylist()) for b in D._split([], True, 1)(iter([batch]))]
        assert sum(sizes) == sum(len(t.split(" ")) - t.split(" ").count("") for t in texts if t) and (most > 1 or len(sizes) == len(texts))
    plan = D.topic_dtm(corpus, stop)._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan


def test_dtm_texts_keep_tasks_for_all_cores(spark):
    """AQE doesn't put the partitions of texts together to about one a core."""
    from sentimetry.operators import dtm as D

    corpus = spark.createDataFrame([(i, f"aaa bbb {'q' * (i % 7 + 3)}") for i in range(400)], "id long, text string")
    dtm = D.topic_dtm(corpus).withColumn("part", F.spark_partition_id())
    assert dtm.select("part").distinct().count() >= D.TASKS_A_CORE * spark.sparkContext.defaultParallelism
