"""Document-term tables and term statistics.

A DTM is the long table ``(id, term, n BIGINT)``: texts are dealt out and sorted
by id, and split and counted by id where they lie, a bounded slice of documents
at a time, so no table of a task's ``(id, term)`` is held or spilled.  Words are
dropped and shortened once for each different one of a slice.
Per-term statistics aggregate partially before their shuffle, so a very common
term costs one row per map task, not one per occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, strip_punctuation, text_clean, text_lower, text_to_ascii
from ..session import materialize
from .tokens import sentence_units, word_tokens


def dtm_build(corpus: DataFrame, stopwords: list[str] | None = None, clean: bool = True,
              with_len: bool = False) -> DataFrame:
    """Counts of the O28 word tokens per document.  With ``with_len`` each
    row carries ``doc_len``, the document's kept tokens: known inside the row
    before it is exploded, so no statistic needs a second pass for it."""
    text = F.translate(text_clean("text") if clean else F.col("text"), "\t+", "  ")  # TOKEN_SPLIT
    out = _counted(_by_id(corpus).select("id", text.alias("w")), stopwords)
    return out if with_len else out.drop("doc_len")


TASKS_A_CORE = 4  # at least, that split texts
SLICE_TOKENS = 1 << 20  # split or counted at once, or those of one text or id


def _by_id(corpus: DataFrame) -> DataFrame:
    """Texts of one id one after the other in one partition: a text is shorter than its rows of counts.
    The partitions aren't put together by AQE, which leaves a few more than there are cores, so most cores wait."""
    spark = corpus.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    return corpus.select("id", "text").repartition(parts, "id").sortWithinPartitions("id")


def _split(stopwords: list[str], digits: bool, min_len: int):
    """Texts (id, w) → their words (id, w ARRAY) between single blanks: stop words dropped, then digits deleted
    unless ``digits``, then words shorter than ``min_len`` dropped."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("w")
            blanks = np.asarray(pc.fill_null(pc.count_substring(texts, " "), 0)).astype(np.int64)
            starts = np.flatnonzero(np.diff((np.cumsum(blanks + 1) - blanks - 1) // SLICE_TOKENS, prepend=-1))
            for at, end in zip(starts, [*starts[1:], len(texts)]):
                lists = pc.split_pattern(texts[at:end], " ")
                coded = lists.flatten().dictionary_encode()
                code, shown = np.asarray(coded.indices), coded.dictionary
                listed = pc.is_in(shown, pa.array(stopwords, pa.string()))
                shown = shown if digits else pc.replace_substring_regex(shown, "[0-9]+", "")
                kept = np.asarray(pc.and_not(pc.greater_equal(pc.utf8_length(shown), min_len), listed))[code]
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                offsets = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
                own = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), shown.take(pa.array(code[kept])))
                yield pa.record_batch([ids[at:end], own], names=["id", "w"])

    return words


def _slice_counts(ids: pa.Array, lists: pa.ListArray) -> Iterator[pa.RecordBatch]:
    """(id, doc_len, cells: (term, n) of each term) of whole ids, whose rows come one after the other."""
    row = np.asarray(ids.dictionary_encode("encode").indices)
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    before, first = np.cumsum(size) - size, np.flatnonzero(np.diff(row, prepend=-1))  # first row of each id
    starts = first[np.flatnonzero(np.diff(before[first] // SLICE_TOKENS, prepend=-1))]
    for at, end in zip(starts, [*starts[1:], len(row)]):
        words = lists.slice(at, end - at).flatten().dictionary_encode()
        terms = len(words.dictionary)
        if not terms:
            continue
        of = np.repeat(row[at:end].astype(np.int64) - row[at], size[at:end])
        cell, n = np.unique(of * terms + np.asarray(words.indices), return_counts=True)
        doc, term = np.divmod(cell, terms)
        some, at_cell = np.unique(doc, return_index=True)
        cells = pa.StructArray.from_arrays([words.dictionary.take(pa.array(term)), pa.array(n)], names=["term", "n"])
        cells = pa.ListArray.from_arrays(pa.array([*at_cell, len(cell)], pa.int32()), cells)
        own = ids.take(pa.array(first[some + row[at]]))
        yield pa.record_batch([own, pa.array(np.bincount(of)[some]), cells], names=["id", "doc_len", "cells"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of rows (id, w) sorted by id; the last id of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []

    def whole() -> tuple[pa.Array, pa.ListArray]:
        table = pa.Table.from_batches(held).combine_chunks()
        return tuple(pa.concat_arrays(table[c].chunks) for c in ("id", "w"))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = batch.column("id")[-1].as_py()
        if held[0].column("id")[0].as_py() == last:
            continue
        ids, lists = whole()
        row = np.asarray(ids.dictionary_encode("encode").indices)
        at = int(np.argmax(row == row[-1]))
        yield from _slice_counts(ids[:at], lists[:at])
        held = [pa.record_batch([ids[at:], lists[at:]], names=["id", "w"])]
    if held:
        yield from _slice_counts(*whole())


def _counted(texts: DataFrame, stopwords: list[str] | None, digits: bool = True, min_len: int = 1) -> DataFrame:
    """Texts ``(id, w)`` of :func:`_by_id` → ``(id, doc_len, term, n)`` of the words that :func:`_split` keeps."""
    words = _split(list(stopwords or []), digits, min_len)
    schema = f"id {texts.schema['id'].dataType.simpleString()}, doc_len long, cells array<struct<term string, n long>>"
    return texts.mapInArrow(lambda batches: _term_counts(words(batches)), schema).select("id", "doc_len", F.inline("cells"))


def topic_dtm(corpus: DataFrame, stopwords: list[str] | None = None, min_len: int = 3,
              with_len: bool = False) -> DataFrame:
    """O40 for the topic scripts (``DocumentTermMatrix`` with its controls), the O23–O27 chain inside one row:
    ASCII only → punctuation deleted → lower → one blank per white-space run → stop words
    removed → digits removed → words shorter than ``min_len`` dropped."""
    text = collapse_whitespace(text_lower(strip_punctuation(text_to_ascii("text"))))
    out = _counted(_by_id(corpus).select("id", text.alias("w")), stopwords, False, min_len)
    return out if with_len else out.drop("doc_len")


def dtm_union_units(corpus: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """Word counts and sentence counts side by side, told apart by ``unit``."""
    words = dtm_build(corpus, stopwords).withColumn("unit", F.lit("word"))
    sents = (sentence_units(corpus.select("id", F.regexp_replace(F.lower("text"), r"[^\p{L}+ \t.!?]", " ")
                                          .alias("text")), stopwords=stopwords)
             .groupBy("id", F.col("unit").alias("term")).agg(F.count("*").alias("n"))
             .withColumn("unit", F.lit("sentence")))
    return words.unionByName(sents)


def top_terms(dtm: DataFrame, n: int) -> DataFrame:
    """The n most frequent terms, ties by term (a TakeOrderedAndProject)."""
    return dtm.groupBy("term").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "term").limit(n)


def doc_frequency(dtm: DataFrame) -> DataFrame:
    """Documents per term (the DTM has one row per document and term)."""
    return dtm.where("n > 0").groupBy("term").agg(F.count("*").alias("df"))


def frequent_terms(dtm: DataFrame, min_total: int) -> DataFrame:
    """Terms with total count ≥ ``min_total``."""
    return dtm.groupBy("term").agg(F.sum("n").alias("total")).where(F.col("total") >= min_total)


def doc_lengths(dtm: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Row sums; with ``docs`` (id) documents without a term get 0."""
    rows = dtm.groupBy("id").agg(F.sum("n").alias("doc_len"))
    if docs is None:
        return rows
    return docs.select("id").join(rows, "id", "left").select("id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))


def term_totals(dtm: DataFrame) -> DataFrame:
    """Column sums."""
    return dtm.groupBy("term").agg(F.sum("n").alias("freq"))


def n_documents(docs: DataFrame) -> F.Column:
    """Number of documents, those without a term included: a column-pruned
    count as a scalar subquery."""
    return docs.select(F.count("*")).scalar()


JOIN_ROWS = 1_000_000  # terms of a side that is broadcast


def join_terms(dtm: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Join a DTM with one row per term.  The side is written and counted: up to
    ``JOIN_ROWS`` terms it is broadcast, so no row of the DTM moves; beyond it both
    are shuffled by term and the side's part is hashed, so the DTM isn't sorted, and
    AQE splits the partition of a term of very many documents."""
    side = materialize(side, "terms")
    return dtm.join(F.broadcast(side) if side.count() <= JOIN_ROWS else side.hint("shuffle_hash"), "term", how)


def _with_len(dtm: DataFrame) -> DataFrame:
    return dtm if "doc_len" in dtm.columns else dtm.join(doc_lengths(dtm), "id")


def _n(dtm: DataFrame, n_docs) -> F.Column:
    return n_docs if n_docs is not None else dtm.select(F.countDistinct("id")).scalar()


def tfidf_docs(dtm: DataFrame, n_docs=None) -> DataFrame:
    """tf = n / Σn of the document, idf = log10(N / df).  ``n_docs``: N,
    from :func:`n_documents`; without it N is the documents in the table."""
    idf = doc_frequency(dtm).select("term", F.log10(_n(dtm, n_docs) / F.col("df")).alias("idf"))
    return join_terms(_with_len(dtm), idf).select(
        "id", "term", (F.col("n") / F.col("doc_len") * F.col("idf")).alias("tfidf"))


def term_tfidf_mean(dtm: DataFrame, n_docs=None) -> DataFrame:
    """Per term, mean over its documents of n / doc_len, times log2(N / df):
    one aggregate by term where the DTM carries ``doc_len``."""
    return (_with_len(dtm).groupBy("term")
            .agg(F.avg(F.col("n") / F.col("doc_len")).alias("m"), F.count("*").alias("df"))
            .select("term", (F.col("m") * F.log2(_n(dtm, n_docs) / F.col("df"))).alias("score")))


def exact_quantiles(df: DataFrame, col: str, ps: list[float], eps: float = 1e-3) -> list[float | None]:
    """Exact quantiles, linear between order statistics (R type 7), without
    bringing all values to one task: approximate quantiles bracket each order
    statistic, the values below the bracket are counted, and only the bracket
    (about 2·eps of the rows) is sorted.  ``df`` should be a written table."""
    values = df.select(F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(ps)
    out = []
    for p in ps:
        rank = (n - 1) * p
        lo, hi = values.approxQuantile("v", [max(0.0, p - eps), min(1.0, p + eps)], eps / 2)
        below, upto = values.agg(F.count_if(F.col("v") < lo), F.count_if(F.col("v") <= hi)).first()
        k = math.floor(rank)
        if not below <= k or upto < min(k + 2, n):  # few rows: the bracket is all of them
            lo, hi, below = float("-inf"), float("inf"), 0
        near = [r.v for r in values.where(F.col("v").between(lo, hi)).orderBy("v").offset(k - below).limit(2).collect()]
        out.append(near[0] + (rank - k) * (near[-1] - near[0]))
    return out


def six_number_summary(df: DataFrame, col: str) -> DataFrame:
    """Min, Q1, median, mean, Q3, max; quantiles as :func:`exact_quantiles`."""
    table = materialize(df.select(col), "summary")
    q1, median, q3 = (F.lit(q).cast("double") for q in exact_quantiles(table, col, [0.25, 0.5, 0.75]))
    return table.agg(F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max")).select(
        "min", q1.alias("q1"), median.alias("median"), "mean", q3.alias("q3"), "max")


def prune_by_tfidf(dtm: DataFrame, threshold: float | None = None, n_docs=None) -> DataFrame:
    """Keep terms whose O47 score is ≥ threshold (the median when None);
    the kept vocabulary reaches the DTM through a semi-join."""
    scores = term_tfidf_mean(dtm, n_docs)
    if threshold is None:
        scores = materialize(scores, "term-scores")
        threshold = exact_quantiles(scores, "score", [0.5])[0]
    keep = scores.where(F.col("score") >= F.lit(threshold)).select("term")
    return join_terms(dtm, keep, "left_semi").select("id", "term", "n")


def prune_sparse_terms(dtm: DataFrame, sparse: float, n_docs=None) -> DataFrame:
    """Keep terms found in more than N·(1−sparse) documents."""
    if not 0 < sparse < 1:
        raise ValueError("sparse must lie strictly between 0 and 1")
    keep = doc_frequency(dtm).where(F.col("df") > _n(dtm, n_docs) * (1 - sparse)).select("term")
    return join_terms(dtm, keep, "left_semi").select("id", "term", "n")


def dtm_slice(dtm: DataFrame, n_docs: int = 20, n_terms: int = 20) -> DataFrame:
    """The dense top-left block (first documents by id, first terms in
    alphabetical order), zeros included.  Both sides are top-k tables of
    at most 20 rows; the term list reaches every document as a scalar array."""
    docs = dtm.groupBy("id").agg(F.count("*")).select("id").orderBy("id").limit(n_docs)
    terms = dtm.select("term").distinct().orderBy("term").limit(n_terms)
    term_arr = terms.select(F.sort_array(F.collect_list("term"))).scalar()
    grid = docs.select("id", F.explode(term_arr).alias("term"))
    return grid.join(dtm, ["id", "term"], "left").select("id", "term", F.coalesce("n", F.lit(0)).alias("n"))
