"""Operator 3: quality classifier by co-training of text and metadata views.

Two logistic models see a document apart: one its text (hashed words and
shape), one its page metadata (language, source, recorded length).  Both start
from labelled documents.  In each round both models score every unlabelled
document in a map with the broadcast weights; what one view is confident of,
beyond quantiles of its scores that follow the proportion of the classes, is
offered to the *other* view's training set.  Then each view is calibrated (Platt)
on labelled documents kept apart, the calibrated views are combined by a last
logistic fit there, and all documents are scored by the combination.

A document is good when its label says quality 1 and not toxic.  A view is fitted
on at most ``fit_rows`` labelled documents, the first by hash of their id, and
``exchange_rows`` that the other view has labelled in this round, drawn from all it is
confident of by hash, with equal chances for every language and source; that
is the bound on what reaches the driver.

Defined results: null or empty text has shape features of zero; null metadata is
a value of its own; labels with a null, or of no document, are ignored; without labels
of both kinds every document is kept with score 1; repeated rows are scored each; a
doc_id with several labels trains with each; of several documents with one id the
one with the least hash of its columns trains; a document without id teaches nothing;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textbytes import WHITE_SPACE, blocks, mix

WORD_BITS = 18
SHAPES = 15  # the last is for marker words, filled in by the model
TEXT_SIZE = (1 << WORD_BITS) + SHAPES
META_SIZE = 1 << 10


@dataclass(frozen=True)
class CoTraining:
    fit_rows: int = 8_000
    exchange_rows: int = 2_000
    rounds: int = 3
    confident: float = 0.98
    steps: int = 150
    ridge: float = 1e-4
    least_rows: int = 4  # of the training set, that a hashed word needs
    marker: float = 2.5  # evidence against a document from which a word is a marker
    apart: int = 5  # one labelled document in so many is kept for calibration
    least_good: float = 0.5


class Rows:
    """Sparse rows: ``column`` and ``value`` of row i at first[i]:first[i + 1]."""

    def __init__(self, column: np.ndarray, value: np.ndarray, count: np.ndarray):
        self.column, self.value, self.count = column, value, count
        self.row = np.repeat(np.arange(len(count), dtype=np.int32), count)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column] * self.value, len(self.count))

    def sums(self, per_row: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, per_row[self.row] * self.value, size)

    def take(self, which: np.ndarray) -> Rows:
        first = np.cumsum(self.count) - self.count
        count = self.count[which]
        at = np.repeat(first[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return Rows(self.column[at], self.value[at], count)


def joined(parts: list[Rows]) -> Rows:
    return Rows(*(np.concatenate([getattr(x, c) for x in parts]) for c in ("column", "value", "count")))


def text_features(block) -> Rows:
    """Hashed lower-case words that a text has, and its shape."""
    data, n = block.data, len(block)
    size = np.maximum(block.end - block.start, 1)
    share = lambda mask: (lambda c: (c[block.end] - c[block.start]) / size)(np.concatenate([[0], np.cumsum(mask)]))
    upper, digit = share((data >= 65) & (data <= 90)), share((data >= 48) & (data <= 57))
    beyond = share(data >= 128)
    symbol = np.zeros(256, bool)
    symbol[[*b"#*$%&|<>=+~^_\\/{}[]@"]] = True
    mark = np.zeros(256, bool)
    mark[[*b"!?.,;:"]] = True
    symbols, marks, loud = share(symbol[data]), share(mark[data]), share(data == 33)
    block.lower()
    start, end, text = block.words(WHITE_SPACE)
    edge = (block.data >= 97) & (block.data <= 122) | (block.data >= 128)  # words without marks around them
    first, last = start.copy(), end.copy()
    for _ in range(4):
        first = np.where((first < last) & ~edge[np.minimum(first, len(edge) - 1)], first + 1, first)
        last = np.where((first < last) & ~edge[np.maximum(last - 1, 0)], last - 1, last)
    word = block.hashes(first, last)
    n_words = np.bincount(text, minlength=n)
    both = np.unique(mix(word) >> np.uint64(64 - WORD_BITS) | text.astype(np.uint64) << np.uint64(WORD_BITS))
    column, owner = (both & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), (both >> np.uint64(WORD_BITS)).astype(np.int64)
    fresh = np.bincount(owner, minlength=n) / np.maximum(n_words, 1)
    plain = np.bincount(text, last > first, n) / np.maximum(n_words, 1)
    steps = [symbols > 0.03, symbols > 0.1, upper > 0.3, fresh < 0.4, plain < 0.9]
    shape = np.stack([10 * upper, 10 * digit, 10 * symbols, 10 * marks, 20 * loud, 2 * fresh, np.log1p(n_words) / 4, 2 * beyond, np.minimum(size / np.maximum(n_words, 1), 20) / 5, *(3.0 * x for x in steps), np.zeros(n)], axis=1)
    shape[n_words == 0] = 0
    column = np.concatenate([column, np.tile((1 << WORD_BITS) + np.arange(SHAPES), n)])
    weight = 0.5 * np.minimum(1, 12 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1)))  # a long text isn't surer
    value = np.concatenate([weight[owner], shape.ravel()])
    order = np.argsort(np.concatenate([owner, np.repeat(np.arange(n), SHAPES)]), kind="stable")
    return Rows(column[order], value[order], np.bincount(owner, minlength=n) + SHAPES)


def meta_features(lang: list, source: list, n_chars: list) -> Rows:
    """Hashed values of language, source, both, and the band of the recorded length."""
    rows = [(f"l{a}", f"s{b}", f"b{a}/{b}", f"n{None if c is None or c < 0 else int(np.log2(c + 1) * 2)}") for a, b, c in zip(lang, source, n_chars)]
    column = np.array([zlib.crc32(x.encode()) % META_SIZE for r in rows for x in r], np.int64)
    return Rows(column, np.ones(len(column)), np.full(len(rows), 4))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def evidence(rows: Rows, y: np.ndarray, size: int, p: CoTraining) -> np.ndarray:
    """Of each column, the log ratio of its smoothed rates among good and other
    rows; 0 for rare ones."""
    seen = np.bincount(rows.column, minlength=size)
    good = np.bincount(rows.column, y[rows.row], size)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    ratio = np.log((good + 2 * rate) / rate) - np.log((seen - good + 2 * (1 - rate)) / (1 - rate))
    return np.where(seen >= p.least_rows, ratio, 0.0)


def fit_logistic(rows: Rows, y: np.ndarray, size: int, p: CoTraining) -> np.ndarray:
    """Weights and, last, the bias: steps of adaptive size on the penalised log
    loss, over hashed words scaled by their evidence."""
    scaled = np.abs(evidence(rows, y, size, p))
    scaled[1 << WORD_BITS :] = 1.0  # shapes
    told = scaled[rows.column] != 0  # rare words are no evidence
    column, count = rows.column[told], np.bincount(rows.row[told], minlength=len(y))
    used, place = np.unique(column, return_inverse=True)
    own = _descend(Rows(place, (rows.value * scaled[rows.column])[told], count), y, len(used), p)
    w = np.zeros(size + 1)
    w[used], w[-1] = own[:-1] * scaled[used], own[-1]
    return w


def _descend(rows: Rows, y: np.ndarray, size: int, p: CoTraining) -> np.ndarray:
    w, scale, b, b_scale = np.zeros(size), np.full(size, 1e-8), 0.0, 1e-8
    for _ in range(p.steps):
        off = (sigmoid(rows.dot(w) + b) - y) / len(y)
        slope = rows.sums(off, size) + p.ridge * w
        scale += slope * slope
        b_scale += off.sum() ** 2
        w -= 0.3 * slope / np.sqrt(scale)
        b -= 0.3 * off.sum() / np.sqrt(b_scale)
    return np.append(w, b)


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a few columns; the bias is last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = sigmoid(x @ w)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (q - y) + ridge * w)
        w -= np.clip(step, -2, 2)
    return w


def with_markers(rows: Rows, marker: np.ndarray) -> Rows:
    """``rows`` with the last shape set to the marker words a text has, 3 at most."""
    value = rows.value.copy()
    value[np.cumsum(rows.count) - 1] = 2 * np.minimum(np.bincount(rows.row, marker[rows.column], len(rows.count)), 3)
    return Rows(rows.column, value, rows.count)


def logits(rows: Rows, weights: np.ndarray) -> np.ndarray:
    return rows.dot(weights[:-1]) + weights[-1]


def offered_in_memory(text: Rows, meta: Rows, p: CoTraining):
    """The exchange over unlabelled rows that are at hand."""

    def offer(weights: dict, marker: np.ndarray, prior: float, share: float) -> dict:
        views = {"text": with_markers(text, marker), "meta": meta}
        out = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            logit = logits(views[v], weights[v])
            each = len(logit) * share
            good, bad = np.argsort(-logit, kind="stable")[: int(each * prior)], np.argsort(logit, kind="stable")[: int(each * (1 - prior))]
            good, bad = good[sigmoid(logit[good]) >= p.confident], bad[sigmoid(logit[bad]) <= 1 - p.confident]
            out[other] = views[other].take(np.concatenate([good, bad])), np.repeat([1.0, 0.0], [len(good), len(bad)])
        return out

    return offer


def co_train(text: Rows, meta: Rows, label: np.ndarray, p: CoTraining, offer=None) -> dict | None:
    """``label``: 1 good, 0 not, -1 unlabelled.  ``offer``: (weights, marker words, rate of
    good ones, share of the unlabelled) to (rows, labels) for each view, from what the
    other is sure of; by default from the unlabelled rows given.  None without both kinds."""
    known = np.flatnonzero(label >= 0)
    kept_apart = known[np.arange(len(known)) % p.apart == 0] if len(known) >= 10 * p.apart else known
    train = np.setdiff1d(known, kept_apart) if len(kept_apart) < len(known) else known
    if any(len(set(label[x].tolist())) < 2 for x in (train, kept_apart)):
        return None
    offer = offer or offered_in_memory(text.take(np.flatnonzero(label < 0)), meta.take(np.flatnonzero(label < 0)), p)
    marker = evidence(text.take(train), label[train].astype(float), TEXT_SIZE, p) <= -p.marker
    marker[1 << WORD_BITS :] = False
    text = with_markers(text, marker)
    sizes = {"text": TEXT_SIZE, "meta": META_SIZE}
    own, held = ({"text": text.take(which), "meta": meta.take(which)} for which in (train, kept_apart))
    del text, meta  # a driver holds each row once
    prior, taught, weights = label[train].mean(), {}, {}
    for round_ in range(p.rounds + 1):
        for v, size in sizes.items():
            rows, y = taught.get(v, (own[v].take(np.zeros(0, np.int64)), np.zeros(0)))
            weights[v] = fit_logistic(joined([own[v], rows]), np.concatenate([label[train].astype(float), y]), size, p)
        if round_ < p.rounds:  # what one view is sure of teaches the other
            taught = offer(weights, marker, prior, (round_ + 1) / (2 * p.rounds))
    logit = {v: logits(held[v], weights[v]) for v in sizes}
    y = label[kept_apart].astype(float)
    platt = {v: fit_dense(logit[v][:, None], y) for v in sizes}
    calibrated = np.stack([logit[v] * platt[v][0] + platt[v][1] for v in sizes], axis=1)
    both = fit_dense(calibrated, y)
    return {"weights": {v: w.astype(np.float32) for v, w in weights.items()}, "marker": marker, "platt": platt, "both": both}


def combined(model: dict, text: Rows, meta: Rows) -> tuple[np.ndarray, ...]:
    """(probability by text, by metadata, by both) of being good."""
    text = with_markers(text, model["marker"])
    c = [logits(rows, model["weights"][v]) * model["platt"][v][0] + model["platt"][v][1] for v, rows in (("text", text), ("meta", meta))]
    return sigmoid(c[0]), sigmoid(c[1]), sigmoid(c[0] * model["both"][0] + c[1] * model["both"][1] + model["both"][2])


FEATURES = "label int, text_column array<int>, text_value array<float>, meta_column array<int>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, block in blocks(batch.column("text")):
            n = len(block)
            own = batch.slice(at, n)
            text = text_features(block)
            meta = meta_features(*(own.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
            cell = lambda x, count, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(x.astype(kind)))
            yield pa.record_batch([own.column("label"), cell(text.column, text.count, np.int32), cell(text.value, text.count, np.float32), cell(meta.column, meta.count, np.int32)], names=["label", "text_column", "text_value", "meta_column"])


META = ("lang", "source", "n_chars")
STRATA = 4096  # classes of (language, source) that draw alike; bounds the broadcast of their counts


def _read(rows: DataFrame) -> tuple[Rows, Rows, np.ndarray]:
    """Features of a bounded table (text, lang, source, n_chars, label), in the driver."""
    got = rows.select("text", *META, "label").mapInArrow(_features, FEATURES).toArrow().combine_chunks()
    cell = lambda c: got.column(c).combine_chunks()
    flat = lambda c: cell(c).flatten().to_numpy() if got.num_rows else np.zeros(0)
    count = lambda c: np.diff(np.asarray(cell(c).offsets)) if got.num_rows else np.zeros(0, np.int64)
    text = Rows(flat("text_column").astype(np.int32), flat("text_value").astype(np.float32), count("text_column"))  # as they came: half the room
    meta = Rows(flat("meta_column").astype(np.int32), np.ones(len(flat("meta_column"))), count("meta_column"))
    return text, meta, got.column("label").to_numpy()


def _with_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents of a bounded table (doc_id, label): one a doc_id and label, in order."""
    every = F.struct(F.xxhash64("text", *META).alias("hash"), "text", *META)
    one = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(every).alias("d"))
    return one.select("doc_id", "label", "d.*").orderBy("doc_id", "label")


LOGITS = "doc_id long, lang string, source string, n_chars long, text double, meta double"


def _logits(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, marker = shared.value
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                own = batch.slice(at, len(block))
                text = logits(with_markers(text_features(block), marker), weights["text"])
                meta = logits(meta_features(*(own.column(c).to_pylist() for c in META)), weights["meta"])
                yield pa.record_batch([*(own.column(c) for c in ("doc_id", *META)), pa.array(text), pa.array(meta)], names=["doc_id", *META, "text", "meta"])

    return score


def offered_by_corpus(docs: DataFrame, labelled: DataFrame, p: CoTraining):
    """The exchange over all unlabelled documents: a map scores them, quantiles of either
    view's scores say what it is sure of, and the other view gets a bounded draw of that.
    The thin rows of scores are parted from the ``labelled`` ids, so no text is shuffled."""
    spark = docs.sparkSession
    edge = float(np.log(p.confident / (1 - p.confident)))

    def offer(weights: dict, marker: np.ndarray, prior: float, share: float) -> dict:
        sent = spark.sparkContext.broadcast(({v: w.astype(np.float32) for v, w in weights.items()}, marker))
        scored = docs.where("doc_id is not null").mapInArrow(_logits(sent), LOGITS)
        scored = stored(scored.join(labelled, "doc_id", "left_anti"), "quality-logits")
        sent.destroy()
        at = [float(1 - share * prior), float(share * (1 - prior))]
        cuts = scored.agg(*(F.percentile_approx(v, at, 10_000).alias(v) for v in ("text", "meta"))).first()
        stratum = F.pmod(F.xxhash64("lang", "source"), F.lit(STRATA))
        chance = (F.xxhash64("doc_id", F.lit(11)).bitwiseAND((1 << 52) - 1).cast("double") + 1) * F.col("n")
        out = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            high, low = cuts[v] or (np.inf, -np.inf)
            sure = F.when(F.col(v) >= max(high, edge), 1).when(F.col(v) <= min(low, -edge), 0)
            picked = scored.select("doc_id", *META, stratum.alias("stratum"), sure.alias("label")).where("label is not null")
            counts = picked.groupBy("stratum", "label").agg(F.count("*").alias("n"))  # 2 * STRATA rows at most
            drawn = picked.join(F.broadcast(counts), ["stratum", "label"]).withColumn("chance", chance)
            most = {1: round(p.exchange_rows * prior), 0: round(p.exchange_rows * (1 - prior))}
            part = [drawn.where(F.col("label") == y).orderBy("chance", "doc_id", *META).limit(n) for y, n in most.items()]
            chosen = part[0].unionByName(part[1])
            if other == "meta":
                rows = chosen.select(*META, "label").orderBy(*META, "label").toArrow()
                features = meta_features(*(rows.column(c).to_pylist() for c in META))
                out[other] = features, rows.column("label").to_numpy().astype(float)
            else:
                ids = stored(chosen.groupBy("doc_id").agg(F.min("label").alias("label")), "quality-chosen")
                features, _, y = _read(_with_text(docs, ids))  # exchange_rows ids at most
                out[other] = with_markers(features, marker), y.astype(float)
        return out

    return offer


def fit(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> dict | None:
    """The model, from at most ``fit_rows`` labelled and, a round, ``exchange_rows`` other documents at a time."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("label")).where("doc_id is not null and label is not null")
    rank = [F.xxhash64(F.col("doc_id"), F.lit(3)), F.col("doc_id")]
    known = labels.join(docs.select("doc_id"), "doc_id", "left_semi").distinct().orderBy(*rank, "label").limit(p.fit_rows)
    offer = offered_by_corpus(docs, labels.select("doc_id").distinct(), p)
    return co_train(*_read(_with_text(docs, known)), p, offer)  # fit_rows ids at most, so they may be broadcast


SCORES = "doc_id long, text_score double, meta_score double, score double, kept boolean"


def _score(shared, least_good: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                n = len(block)
                own = batch.slice(at, n)
                meta = meta_features(*(own.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
                a, b, both = combined(model, text_features(block), meta) if model else (np.ones(n),) * 3
                yield pa.record_batch([own.column("doc_id"), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= least_good)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return score


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def quality_scores(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of every row of ``docs``
    (doc_id, text, lang, source, n_chars); ``labels``: doc_id, quality, toxic."""
    docs = _plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))
    return docs.mapInArrow(_score(shared, p.least_good), SCORES)


def good_documents(docs: DataFrame, labels: DataFrame, p: CoTraining = CoTraining()) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(_plain(docs), labels, p))
    score = _score(shared, p.least_good)
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [cell for part in score(iter([batch.select(["doc_id", "text", "lang", "source", "n_chars"])])) for cell in part.column("kept").to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_())).select(names)

    return docs.mapInArrow(keep, docs.schema)
