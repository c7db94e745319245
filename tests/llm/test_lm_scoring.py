import collections
import math
import random
import re
import zlib

import numpy as np
from helpers import documents, lorem, with_clashes
from pyspark.sql import functions as F
from sentimetry.llm import lm_scoring as op

SMALL = op.Model(head_words=64, least_segments=16)


def training():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def brute(rows):
    count = collections.Counter()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, text in rows:
        if not held[i]:
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for i, text in rows:
        own = tokens(text)
        out.append((i, held[i], len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)))
    return out


def scores(spark, rows, model=SMALL):
    return op.lm_scores(with_clashes(documents(spark, rows)), training(), model).collect()


def check(spark, rows):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scores(spark, rows)), key=repr)
    assert got == sorted(((*b[:5], round(b[5], 6)) for b in brute(rows)), key=repr)


def test_base_score_against_counts(spark):
    rng = random.Random(1)
    rows = [(i, lorem(rng, rng.randrange(0, 120), 300).title() + " Ärger x\ty") for i in range(60)]
    rows += [(60, None), (61, ""), (62, "   "), (63, "the " * 5000), (None, "no id"), (7, "again"), (7, "again")]
    check(spark, rows)


def test_empty_table(spark):
    assert op.lm_scores(documents(spark, [(1, "a")]).where("false"), training(), SMALL).collect() == []


def test_model_beats_the_base_on_held_out_text(spark):
    """Text from a first-order chain: pairs tell more than words alone."""
    rng = random.Random(2)
    follow = {w: [rng.randrange(200) for _ in range(3)] for w in range(200)}

    def text():
        w = rng.randrange(200)
        out = []
        for _ in range(150):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    held = [r for r in scores(spark, [(i, text()) for i in range(200)]) if r.held_out]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)


def by_segments(entry, count, model, segments):
    segment = op.segment_of(entry, segments)
    parts = [op.fill_segment(entry[segment == s], count[segment == s], model) for s in range(segments)]
    return op.Filter(b"".join(parts), np.array([len(x) // 8 for x in parts]), model)


def test_probabilities_sum_to_about_one():
    """Over the vocabulary and one unknown word, after known and unknown contexts."""
    rng = np.random.default_rng(3)
    model = op.Model()
    words = rng.integers(1, 1 << 62, 50).astype(np.uint64)
    text = words[rng.zipf(1.5, 20000) % 50]
    owner = np.zeros(len(text), np.int64)
    keys, counts = np.unique(text, return_counts=True)
    keys, counts = np.append(keys, op.END), np.append(counts, 1)
    pairs, at, pair_counts = np.unique(op.pairs_of(text, owner), return_index=True, return_counts=True)
    contexts = op.context_of(text, owner, text, op.END)[at]
    source = by_segments(np.concatenate([keys, pairs]), np.concatenate([counts, pair_counts]), model, 8)
    level = op.levels_of(counts, model.step)
    follow = np.array([(contexts == k).sum() for k in keys])
    mass = np.ones(len(op.level_values(model.step)))
    for j in set(level.tolist()):
        mass[j] = model.discount * follow[level == j].sum() / counts[level == j].sum()
    scorer = op.Scorer(source, model, int(counts.sum()), len(keys), mass)
    for before in (keys[np.argmax(counts)], np.uint64(12345)):
        every = np.append(keys, np.uint64(999))
        token = np.stack([np.full(len(every), before), every], axis=1).ravel()
        p = 10 ** scorer.log10(token, np.repeat(np.arange(len(every)), 2))[1::2]
        assert 0.85 < p.sum() < 1.15


def test_filter_holds_every_entry():
    """However many n-grams a segment has: none reads low, few read high, none is left out."""
    rng = np.random.default_rng(4)
    model = op.Model()
    for n in (0, 1, 20, 40_000):
        entry = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        count = rng.zipf(1.4, n).clip(1, 1 << 40)
        level = op.levels_of(count, model.step)
        source = by_segments(entry, count, model, 16)
        got = source.levels(entry)
        assert (got >= level).all() and (got > level).mean() < 0.05 if n else len(got) == 0
        assert (source.levels(rng.integers(0, 1 << 62, 5000).astype(np.uint64)) > 0).mean() < 0.05
        assert len(source.words) * 64 <= level.sum() * model.bits_per_entry + 17 * 64


def test_full_filter_ends():
    """On a filter of ones every probe ends at the top level of the table."""
    model = op.Model()
    source = op.Filter(b"\xff" * 1024, np.full(4, 32), model)
    level = source.levels(np.random.default_rng(5).integers(0, 1 << 62, 2000).astype(np.uint64))
    values = op.level_values(model.step)
    assert (level == len(values) - 1).all() and np.isfinite(values[level]).all()


def exact_model(rows, model):
    """The model with true counts, quantised, in place of the filter."""
    words, pairs, follow = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    for i, text in rows:
        if not held[i]:
            own = tokens(text)
            words.update(own)
            for a, b in zip([None, *own], own):
                pairs[a, b] += 1
                follow[a].add(b)
    value, n, v = op.level_values(model.step), sum(words.values()), len(words)
    level = lambda c: int(op.levels_of(np.array([c]), model.step)[0])
    free, seen = collections.Counter(), collections.Counter()
    for w, c in words.items():
        free[level(c)] += model.discount * len(follow[w])
        seen[level(c)] += c
    out = {}
    for i, text in rows:
        own, total = tokens(text), 0.0
        for a, b in zip([None, *own], own):
            single, context = (value[level(words[b])] + 1) / (n + v + 1), level(words[a])
            p = single
            if context:
                p = max(value[level(pairs[a, b])] - model.discount, 0) / value[context] + free[context] / seen[context] * single
            total += math.log10(min(p, 1.0))
        out[i] = total
    return out


def test_score_against_exact_counts(spark):
    """With so many bits that no probe errs, the score is that of the true counts."""
    rng = random.Random(6)
    rows = [(i, lorem(rng, rng.randrange(0, 150), 200)) for i in range(80)] + [(80, None), (81, "once only")]
    want = exact_model(rows, op.Model())
    got = {r.doc_id: r.score for r in scores(spark, rows, op.Model(bits_per_entry=4000, head_words=64, least_segments=4))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_filter_beyond_the_broadcast_bound(spark):
    """Texts that meet the segments where they lie score as with the filter sent."""
    rng = random.Random(7)
    rows = [(i, lorem(rng, rng.randrange(0, 200), 500)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "deep " * 20000), (None, "no id"), (5, "again"), (5, "again")]
    key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.score, 9), round(r.base_score, 9), r.n_known, r.held_out)
    sent = sorted(map(key, scores(spark, rows)))
    apart = sorted(map(key, scores(spark, rows, op.Model(head_words=64, least_segments=16, broadcast_bytes=0))))
    assert sent == apart
    assert op.lm_scores(documents(spark, [(1, "a")]).where("false"), training(), op.Model(broadcast_bytes=-1)).collect() == []


def test_segments_follow_the_text():
    model = op.Model()
    assert model.segments(0) == 256 and model.segments(30 << 30) == 16384 and op.Model(least_segments=1).segments(0) == 1


def test_questions_follow_the_text_not_the_segments(spark, monkeypatch):
    """A chunk asks each bucket of segments once, however many segments there are, and may come in pieces."""
    rng = random.Random(8)
    rows = [(i, lorem(rng, rng.randrange(0, 200), 3000)) for i in range(150)]
    key = lambda r: (r.doc_id, r.n_tokens, round(r.score, 9), round(r.base_score, 9), r.n_known)
    want = sorted(map(key, scores(spark, rows, op.Model(head_words=64, least_segments=512))))
    frame, asked = type(spark.range(1)), []
    mapped = frame.mapInArrow

    def spy(df, f, *schema):
        out = mapped(df, f, *schema)
        if f.__name__ == "ask":
            asked.append(out)
        return out

    monkeypatch.setattr(frame, "mapInArrow", spy)
    monkeypatch.setattr(op, "BUCKET_BYTES", 1 << 14, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        apart = scores(spark, rows, op.Model(head_words=64, least_segments=512, broadcast_bytes=0))
        questions = asked[0].count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(key, apart)) == want
    assert len(rows) / 11 <= questions < 300
