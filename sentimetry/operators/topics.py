"""Topic models and topic tables (O83–O100).

θ is ``(doc_id, topic, theta)`` and φ is ``(topic, term, phi)``, both long.
Relational operators work on any θ/φ (fitted or stand-ins).  Statistics of topic
pairs need no join: a term is one row with a vector over the topics, a task adds
up outer products of these vectors, and only topics × topics numbers leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import safe_corr
from .dtm import n_documents, prune_by_tfidf, prune_sparse_terms
from .lda import TopicModels, lda_em


# --- relational topic tables -------------------------------------------------
def topic_of_doc(theta: DataFrame) -> DataFrame:
    """Most likely topic per document (ties: lower topic), one partial +
    final aggregate with ``max_by``."""
    return theta.groupBy("doc_id").agg(
        F.max_by("topic", F.struct(F.col("theta"), -F.col("topic").cast("double"))).alias("topic"))


def topic_top_terms(phi: DataFrame, t: int = 20) -> DataFrame:
    """Top T terms per topic with rank (ties by term)."""
    w = Window.partitionBy("topic").orderBy(F.desc("phi"), "term")
    return phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= t)


def topic_label(top_terms: DataFrame, n: int = 3) -> DataFrame:
    """label = the n best terms joined by a blank."""
    return top_terms.where(F.col("rank") <= n).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]),
                     " ").alias("label"))


def docs_with_topic(corpus: DataFrame, doc_topics: DataFrame) -> DataFrame:
    """Corpus inner-joined with each document's topic."""
    return corpus.join(doc_topics.withColumnRenamed("doc_id", "id"), "id")


def topic_share(theta: DataFrame, doc_len: DataFrame) -> DataFrame:
    """Σ_d θ·len / Σ_d len per topic."""
    j = theta.join(doc_len, "doc_id")
    tot = j.select("doc_id", "len").distinct().select(F.sum("len")).scalar()
    return j.groupBy("topic").agg((F.sum(F.col("theta") * F.col("len")) / tot).alias("share"))


def topic_term_relevance(phi: DataFrame, term_freq: DataFrame, lambdas: list[float], r: int = 30) -> DataFrame:
    """Per λ and topic the top R terms by λ·log φ + (1−λ)·log(φ/p(term)),
    with logprob and loglift; p(term) = frequency share over the vocabulary."""
    tot = term_freq.select(F.sum("freq")).scalar()
    p = term_freq.select("term", (F.col("freq") / tot).alias("pterm"))
    base = phi.join(p, "term").select("topic", "term", F.log("phi").alias("logprob"),
                                      F.log(F.col("phi") / F.col("pterm")).alias("loglift"))
    lam = F.explode(F.array(*[F.lit(float(x)) for x in lambdas])).alias("lambda")
    rel = base.select("*", lam).withColumn(
        "relevance", F.col("lambda") * F.col("logprob") + (1 - F.col("lambda")) * F.col("loglift"))
    w = Window.partitionBy("lambda", "topic").orderBy(F.desc("relevance"), "term")
    return rel.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= r)


def term_rows(phi: DataFrame) -> tuple[list, DataFrame]:
    """(topics in order, (term, shares)): one row per term, a vector over the topics."""
    topics = sorted(r[0] for r in phi.select("topic").distinct().collect())
    cells = [F.coalesce(F.max(F.when(F.col("topic") == t, F.col("phi"))), F.lit(0.0)) for t in topics]
    return topics, phi.groupBy("term").agg(F.array(*cells).cast("array<double>").alias("shares"))


class PairSums:
    """Sums over terms for each pair of topics p, q of a model: ``dot`` p·q,
    ``cross`` p·ln q and ``middle`` m·ln m with m = (p + q) / 2; logarithms of 0
    count as 0."""

    def __init__(self, k: int):
        self.dot, self.cross, self.middle = np.zeros((3, k, k))

    def distances(self) -> np.ndarray:
        """Jensen–Shannon divergence of each pair."""
        own = np.diag(self.cross)
        return (own[:, None] + own) / 2 - self.middle

    def cosines(self) -> np.ndarray:
        norm = np.sqrt(np.diag(self.dot))
        return self.dot / np.outer(norm, norm)

    def symmetric_divergences(self) -> np.ndarray:
        own = np.diag(self.cross)
        return (own[:, None] - self.cross + own - self.cross.T) / 2


def pair_sums(terms: DataFrame, ks: list[int]) -> list[PairSums]:
    """One pass over ``terms`` (term, shares), the topics of models of ``ks``
    topics side by side.  Each task gives out one row of sums per model."""
    ends = np.cumsum([0, *ks])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((3, k, k)) for k in ks]
        for batch in batches:
            shares = np.asarray(batch.column("shares").flatten()).reshape(batch.num_rows, -1)
            for at in range(0, len(shares), 2048):
                for out, x, y in zip(total, ends, ends[1:]):
                    p = shares[at : at + 2048, x:y]
                    ln = lambda v: np.log(v, out=np.zeros_like(v), where=v > 0)
                    out[0] += p.T @ p
                    out[1] += p.T @ ln(p)
                    for i in range(p.shape[1]):
                        m = (p + p[:, i : i + 1]) / 2
                        out[2, i] += (m * ln(m)).sum(axis=0)
        yield pa.record_batch([pa.array(range(len(ks)), pa.int32()), pa.array([t.ravel() for t in total], pa.list_(pa.float64()))], names=["model", "sums"])

    parts = terms.select("shares").mapInArrow(sums, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "v"))
    out = [PairSums(k) for k in ks]
    for r in parts.groupBy("model", "at").agg(F.sum("v").alias("v")).collect():  # 3 x topics x topics numbers a model
        k = ks[r["model"]]
        which, cell = divmod(r["at"], k * k)
        (out[r["model"]].dot, out[r["model"]].cross, out[r["model"]].middle)[which][divmod(cell, k)] = r["v"]
    return out


def _of_pairs(phi: DataFrame) -> tuple[list, PairSums, list[tuple[int, int]]]:
    topics, terms = term_rows(phi)
    pairs = [(i, j) for j in range(len(topics)) for i in range(j)]
    return topics, pair_sums(terms, [len(topics)])[0] if topics else PairSums(0), pairs


def topic_distance(phi: DataFrame) -> DataFrame:
    """Jensen–Shannon divergence of each pair of topics."""
    topics, sums, pairs = _of_pairs(phi)
    d, kind = sums.distances(), phi.schema["topic"].dataType.simpleString()
    return phi.sparkSession.createDataFrame([(topics[i], topics[j], float(d[i, j])) for i, j in pairs], f"t1 {kind}, t2 {kind}, jsd double")


def theta_by_category(theta: DataFrame, category: DataFrame) -> DataFrame:
    """θ left-joined with the document category, mean θ per category and
    topic (every topic kept)."""
    return theta.join(category, "doc_id", "left").groupBy("category", "topic").agg(
        F.avg("theta").alias("mean_theta"))


def topic_correlation(tbc: DataFrame) -> DataFrame:
    """Correlation of topic pairs over categories."""
    a = tbc.select("category", F.col("topic").alias("t1"), F.col("mean_theta").alias("v1"))
    b = tbc.select("category", F.col("topic").alias("t2"), F.col("mean_theta").alias("v2"))
    return a.join(b, "category").where(F.col("t1") < F.col("t2")).groupBy("t1", "t2").agg(
        safe_corr("v1", "v2").alias("r"))


def topic_diagnostic_ratio(tbc: DataFrame) -> DataFrame:
    """Per category, a topic's mean θ over the sum of the other topics,
    ranked (rank 1 = most diagnostic topic)."""
    w = Window.partitionBy("category")
    ratio = F.try_divide(F.col("mean_theta"), F.sum("mean_theta").over(w) - F.col("mean_theta"))
    r = tbc.withColumn("ratio", ratio)
    return r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("ratio"), "topic"))).select(
        "category", "topic", "ratio", "rank")


def _mean(matrix: np.ndarray) -> float | None:
    """Mean over the pairs of topics; None for fewer than two topics."""
    upper = matrix[np.triu_indices(len(matrix), 1)]
    return float(upper.mean()) if len(upper) else None


def _metric(phi: DataFrame, of) -> DataFrame:
    return phi.sparkSession.createDataFrame([(of(_of_pairs(phi)[1]),)], "value double")


def cao_juan(sums: PairSums) -> float | None:
    return _mean(sums.cosines())


def deveaud(sums: PairSums) -> float | None:
    # k(k−1)/2 pairs, so their mean is twice the value
    mean = _mean(sums.symmetric_divergences())
    return None if mean is None else mean / 2


def metric_cao_juan(phi: DataFrame) -> DataFrame:
    """Mean pairwise cosine similarity of topics (lower is better)."""
    return _metric(phi, cao_juan)


def metric_deveaud(phi: DataFrame) -> DataFrame:
    """Σ over pairs of ½Σx·ln(x/y) + ½Σy·ln(y/x), divided by k(k−1) (higher is better)."""
    return _metric(phi, deveaud)


def metric_normalise(metrics: DataFrame) -> DataFrame:
    """O100: min-max each metric over k."""
    w = Window.partitionBy("metric")
    return metrics.withColumn("scaled", F.try_divide(F.col("value") - F.min("value").over(w),
                                                     F.max("value").over(w) - F.min("value").over(w)))


# --- fitted models -------------------------------------------------------------
def topic_token_table(phi: DataFrame, share: DataFrame) -> DataFrame:
    """O90, token table: share of each topic in a term, φ·topic share over the
    sum of the topics."""
    j = phi.join(share, "topic").select("topic", "term", (F.col("phi") * F.col("share")).alias("w"))
    tot = j.groupBy("term").agg(F.sum("w").alias("tot"))
    return j.join(tot, "term").select("topic", "term", (F.col("w") / F.col("tot")).alias("freq"))


def arun(gram: np.ndarray, totals: np.ndarray, longest: float) -> float:
    """Symmetric KL between the singular values of φ (roots of the eigenvalues
    of φφᵀ) and the length-weighted θ totals over the greatest length."""
    c1 = np.sqrt(np.clip(np.sort(np.linalg.eigvalsh(gram))[::-1], 1e-300, None))
    c2 = np.clip(totals / longest, 1e-300, None)
    return float(np.sum(c1 * np.log(c1 / c2)) + np.sum(c2 * np.log(c2 / c1)))


def metric_arun(phi: DataFrame, theta: DataFrame, doc_len: DataFrame) -> float:
    """O98 of a long φ and θ and document lengths (id, doc_len): the DTM's row sums."""
    topics, sums, _ = _of_pairs(phi)
    longest = doc_len.select(F.max("doc_len")).first()[0]
    totals = theta.join(doc_len.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("topic").agg(
        F.sum(F.col("theta") * F.col("doc_len")).alias("s"))
    by_topic = {r["topic"]: r["s"] for r in totals.collect()}
    return arun(sums.dot, np.array([by_topic.get(t, 0.0) for t in topics]), longest)


def log_likelihood(dtm: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """Σ n·ln Σ_k θ·φ of the text ``dtm`` (id, term, n) under given long θ and φ.
    Pairs without any topic are left out."""
    cells = dtm.join(theta.withColumnRenamed("doc_id", "id"), "id").join(phi, ["topic", "term"])
    mass = cells.groupBy("id", "term", "n").agg(F.sum(F.col("theta") * F.col("phi")).alias("s"))
    return mass.agg(F.sum(F.col("n") * F.log("s")).alias("value"))


def score_models(spark: SparkSession, models: TopicModels, doc_len: DataFrame) -> DataFrame:
    """``(k, metric, value)`` of every fitted model: ``griffiths_bound``
    (log-likelihood of the text under θ and φ), CaoJuan2009, Arun2010,
    Deveaud2014.  One pass over the terms and one over the documents."""
    width = sum(models.ks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            shares = np.asarray(batch.column("shares").flatten()).reshape(batch.num_rows, -1)
            out += np.asarray(batch.column("doc_len"), float) @ shares
        yield pa.record_batch([pa.array([out], pa.list_(pa.float64()))], names=["totals"])

    weighed = models.theta.join(doc_len, "id").select("shares", "doc_len").mapInArrow(totals, "totals array<double>")
    sums = {r["at"]: r["v"] for r in weighed.select(F.posexplode("totals").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()}
    longest = doc_len.select(F.max("doc_len")).first()[0]
    rows, at = [], 0
    for m, (k, pairs) in enumerate(zip(models.ks, pair_sums(models.phi, models.ks))):
        own = np.array([sums.get(at + i, 0.0) for i in range(k)])
        rows += [(k, "griffiths_bound", float(models.log_likelihood[m])), (k, "CaoJuan2009", cao_juan(pairs)),
                 (k, "Deveaud2014", deveaud(pairs)), (k, "Arun2010", arun(pairs.dot, own, longest) if longest else None)]
        at += k
    return spark.createDataFrame(rows, "k int, metric string, value double")


def topic_model(dtm: DataFrame, docs: DataFrame, remove: str = "sparse", p: float = 0.99, k: int = 10,
                seed: int = 622, t: int = 20, **fit) -> dict:
    """O83 wrapper: prune the DTM (``remove`` = ``no``, ``sparse`` or ``tf-idf``),
    fit k topics and return ``model``, ``topics`` (most likely topic of each
    document), ``terms`` (T best terms of each topic), ``theta`` and ``phi``."""
    n = n_documents(docs)
    if remove == "sparse":
        dtm = prune_sparse_terms(dtm, p, n)
    elif remove == "tf-idf":
        dtm = prune_by_tfidf(dtm, None, n)
    elif remove != "no":
        raise ValueError("remove must be 'no', 'sparse' or 'tf-idf'")
    model = lda_em(dtm, docs, [k], seed, **fit)
    theta, phi = model.theta_long(), model.phi_long()
    return {"model": model, "topics": topic_of_doc(theta), "terms": topic_top_terms(phi, t), "theta": theta, "phi": phi}
