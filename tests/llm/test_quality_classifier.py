import random

import numpy as np
from helpers import documents, lorem, with_clashes
from sentimetry.llm import quality_classifier as op

SMALL = op.CoTraining(fit_rows=400, exchange_rows=200, steps=80)


def tables(spark, n=700, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, quality, toxic = lorem(rng, rng.randrange(20, 120)), 1, 0
        if i % 5 == 0:
            quality, text = 0, " ".join(w + rng.choice(["$$$", "###"]) for w in text.split())
        elif i % 7 == 0:
            words = text.split()
            for w in ("scoundrel", "blockhead"):
                words.insert(rng.randrange(len(words)), w)
            toxic, text = 1, " ".join(words)
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{i % 4}"))
        if i % 3 != 1:
            labels.append((i, quality, toxic))
    truth = {i: 0 if i % 5 == 0 or i % 7 == 0 else 1 for i in range(n)}
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = tables(spark)
    got = {r.doc_id: r.kept for r in op.quality_scores(with_clashes(docs), labels, SMALL).collect()}
    hidden = [i for i in truth if i % 3 == 1]
    assert len(got) == len(truth)
    assert np.mean([got[i] == bool(truth[i]) for i in hidden]) > 0.97
    assert np.mean([got[i] for i in hidden if truth[i]]) > 0.98  # clean documents stay


def test_views_teach_each_other():
    """Metadata that tells good from bad, learned from the text view's pseudo-labels alone."""
    rng = np.random.default_rng(0)
    n = 600
    good = rng.random(n) < 0.7
    blocks = next(op.blocks(op.pa.array([("fine words here " if g else "bad### stuff$$$ ") * 8 + str(i) for i, g in enumerate(good)])))[1]
    text = op.text_features(blocks)
    meta = op.meta_features(["en"] * n, ["clean" if g else "junk" for g in good], [100] * n)
    label = np.where(np.arange(n) < 60, good, -1).astype(int)
    model = op.co_train(text, meta, label, op.CoTraining())
    _, by_meta, both = op.combined(model, text, meta)
    assert ((both > 0.5) == good).mean() > 0.99 and by_meta[good].mean() > by_meta[~good].mean() + 0.3


def test_odd_rows(spark):
    docs, labels, _ = tables(spark, 300)
    odd = documents(spark, [(5000, None, None, None), (5001, "", "en", "s"), (None, "no id", "en", "s"), (5002, "x " * 50000, "en", "s"), (5003, "same", "en", "s"), (5003, "same", "en", "s")])
    odd = odd.withColumn("n_chars", op.F.when(op.F.col("doc_id") == 5001, None).otherwise(op.F.col("n_chars")))
    more = spark.createDataFrame([(None, 1, 0), (5000, None, 1), (1, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = op.quality_scores(docs.unionByName(odd), labels.unionByName(more), SMALL).collect()
    assert len(got) == 306 and all(r.kept is not None and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5003}) == 1


def test_without_labels_or_rows(spark):
    docs, labels, _ = tables(spark, 50)
    assert all(r.kept and r.score == 1 for r in op.quality_scores(docs, labels.where("false")).collect())
    assert op.quality_scores(docs.where("false"), labels, SMALL).collect() == []


def test_filter_keeps_columns(spark):
    docs, labels, _ = tables(spark, 200)
    docs = with_clashes(docs)
    kept = op.good_documents(docs, labels, SMALL)
    want = sorted(r.doc_id for r in op.quality_scores(docs, labels, SMALL).collect() if r.kept)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want


def test_exchange_reaches_all_unlabelled_documents(spark):
    """A source that no label covers and that few documents have is learned from the text view's verdicts."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        text = " ".join(w + "###" if bad else w for w in lorem(rng, 60).split())
        source = "rare" if i >= 200 and i % 100 == 0 else f"src{i % 3}"
        rows.append((i, text, "en", source))
        if i < 200:
            labels.append((i, int(not bad), 0))
    docs = documents(spark, rows)
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    p = op.CoTraining(fit_rows=200, exchange_rows=120, steps=80, rounds=2, confident=0.8)
    got = {r.doc_id: r for r in op.quality_scores(docs, given, p).collect()}
    rare = [got[i].meta_score for i, _, _, s in rows if s == "rare"]
    other = [got[i].meta_score for i, _, _, s in rows if s != "rare"]
    assert max(rare) < np.mean(other)


def test_several_documents_with_one_id_rerun_equal(spark):
    docs, labels, _ = tables(spark, 300)
    twice = docs.unionByName(docs.withColumn("text", op.F.upper("text")))
    runs = [sorted((r.doc_id, r.score) for r in op.quality_scores(d, labels, SMALL).collect()) for d in (twice, twice.repartition(7))]
    assert runs[0] == runs[1]


def test_labels_without_documents_take_no_room(spark):
    docs, labels, _ = tables(spark, 300)
    strange = spark.range(10_000, 20_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in op.quality_scores(docs, x, SMALL).collect()) for x in (labels, labels.unionByName(strange)))
    assert a == b


def test_rows_take_twelve_bytes_a_cell(spark):
    """Features reach the driver and are copied as they came, not widened."""
    import numpy as np
    from sentimetry.llm import quality_classifier as Q
    docs = spark.createDataFrame([("some plain words", "en", "src1", 16, 1), (None, None, None, None, 0)], "text string, lang string, source string, n_chars long, label int")
    text, meta, _ = Q._read(docs)
    marked = Q.with_markers(text, np.zeros(Q.TEXT_SIZE, bool))
    for rows in (text, text.take(np.array([1, 0])), Q.joined([text, text]), marked):
        assert sum(getattr(rows, c).itemsize for c in ("column", "value", "row")) == 12
    assert meta.column.itemsize == 4 and text.dot(np.ones(Q.TEXT_SIZE)).dtype == float
