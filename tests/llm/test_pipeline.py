import random

import corpus_pipeline
from helpers import documents, lorem, stage_folder
from test_decontamination import brute as contaminated
from test_line_dedup import brute as lines
from test_mixing import water_filling
from test_order_minhash import brute as classes
from test_order_minhash import edited


def folder(spark, tmp_path):
    rng = random.Random(1)
    items = [(k, lorem(rng, 40, 10**6)) for k in range(3)]
    rows = [(i, lorem(rng, rng.randrange(30, 90), 10**5), "en", f"src{i % 3}") for i in range(120)]
    rows = [(i, "Shared boilerplate line.\n" + t if i % 4 == 0 else t, a, b) for i, t, a, b in rows]
    rows += [(200 + i, edited(rng, rows[i][1], 1), "en", "src0") for i in range(12)]
    rows += [(300 + i, lorem(rng, 20, 10**5) + " " + items[i][1], "en", "src1") for i in range(3)]
    rows += [(400 + i, " ".join(w + "###" for w in lorem(rng, 60).split()), "en", "src2") for i in range(40)]
    labels = [(r[0], int(r[0] < 400), 0) for r in rows if r[0] % 3]
    return rows, items, stage_folder(
        tmp_path, documents=documents(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id long, text string")
    )


def test_each_stage_on_its_own_input(spark, tmp_path):
    rows, items, path = folder(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "mixture"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text, r.lang, r.source) for r in docs.collect())
        docs = corpus_pipeline.stored(stage(spark, docs, path), name)
        got = sorted(docs.collect(), key=lambda r: r.doc_id)
        texts = [(r.doc_id, r.text) for r in got]
        if name == "quality":
            assert [r.doc_id for r in got] == [r[0] for r in rows if r[0] < 400]
        elif name == "lines":
            want = lines(before, 0.1, 5)
            assert texts == sorted(w[:2] for w in want) and any(w[2] for w in want)
        elif name == "near_duplicates":
            kept = {before[c][0] for c in classes([b[1] for b in before])}
            assert {r.doc_id for r in got} == kept and len(kept) < len(before)
        elif name == "benchmark":
            assert [r.doc_id for r in got] == [w[0] for w in sorted(contaminated([b[:2] for b in before], items), key=lambda w: w[0]) if not w[-1]]
            assert not any(300 <= r.doc_id < 400 for r in got)
        else:
            sizes = {}
            for _, text, _, source in before:
                sizes[source] = sizes.get(source, 0) + len(text.split())
            for source, target in water_filling(sizes).items():
                taken = sum(r.copies * len(r.text.split()) for r in got if r.source == source)
                assert abs(taken - target) <= 0.03 * target
        assert docs.columns == columns + ["copies"] * (name == "mixture")


def test_run(spark, tmp_path):
    _, _, path = folder(spark, tmp_path)
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and all(0 < r.copies <= 3 and r.doc_id < 300 for r in rows)


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing columns pass the stages unchanged."""
    rows, _, path = folder(spark, tmp_path)
    docs = documents(spark, [r for r in rows if r[0] < 400] + [(900, None, None, None), (901, "", "en", None), (902, "one word", "en", "src1"), (902, "one word", "en", "src1")])
    docs = docs.selectExpr("*", *(f"doc_id + 0.5D as {c}" for c in ("n_words", "copies", "lines_dropped", "taken", "n_hit")), "cast(doc_id as string) as items", "doc_id % 2 = 0 as contaminated", "doc_id as page", "doc_id as doc", "doc_id as hits", "doc_id as kept")
    before = {r.doc_id: r.asDict() for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert out.schema.names == docs.schema.names + ["mix_copies"] * (name == "mixture")
        got = [r.asDict() for r in out.collect()]
        assert got
        for r in got:
            if name == "mixture":
                assert 0 < r.pop("mix_copies") <= 3
            assert {**r, "text": 0} == {**before[r["doc_id"]], "text": 0}
            assert name == "lines" or r["text"] == before[r["doc_id"]]["text"]
        empty = stage(spark, docs.where("false"), path)
        assert empty.columns == out.columns and empty.collect() == []
