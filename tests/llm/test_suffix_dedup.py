import hashlib
import random

import numpy as np
from helpers import documents, lorem, with_clashes
from sentimetry.llm import suffix_dedup as op

W = 200


def brute(texts, width):
    """(removed, spans, sha) of each text, by a table of all windows."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - width + 1):
            seen[d[p : p + width]] = seen.get(d[p : p + width], 0) + 1
    out = []
    for d in data:
        mark = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if seen[d[p : p + width]] > 1:
                mark[p : p + width] = b"\1" * width
        spans = sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1]))
        kept = bytes(c for c, m in zip(d, mark) if not m)
        out.append((len(d), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, width=W):
    docs = with_clashes(documents(spark, list(enumerate(texts))))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op.digest(op.repeated_spans(docs, width)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, width)


def corpus(rng):
    base, passage = lorem(rng, 300), lorem(rng, 60)
    texts = [lorem(rng, rng.randrange(1, 400)) for _ in range(20)]
    texts += [base, base, base + " tail", "head " + base, base[:700] + "é" + base[700:]]  # copies and near copies
    texts += [lorem(rng, 40) + passage + lorem(rng, 40) for _ in range(8)]  # a shared passage
    texts += ["Orre " * 400, "Orre " * 90, "x" * 500, "x" * 200, "x" * 199, "aé" * 300]  # texts that repeat themselves
    texts += [passage + " " + lorem(rng, 30) + " " + passage]
    texts += [None, "", "short", "ß" * 3000]
    return texts


def test_against_all_windows(spark):
    check(spark, corpus(random.Random(5)))


def test_hot_anchors_are_split(spark, monkeypatch):
    monkeypatch.setattr(op, "HOT_RUNS", 2)
    rng = random.Random(6)
    passage = lorem(rng, 50)
    check(spark, corpus(rng) + [lorem(rng, 20) + passage + lorem(rng, 20) for _ in range(12)])


def test_small_width(spark):
    check(spark, ["abcabcabc", "xxabcabc", "zzz", "", None, "abca"], 6)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(7)
    text = lorem(rng, 80)
    docs = documents(spark, [(1, text), (1, text), (None, lorem(rng, 80)), (None, None)])
    rows = sorted((r.doc_id or -1, r.n_removed, r.n_spans) for r in op.digest(op.repeated_spans(docs, W)).collect())
    n = len(text)
    assert rows == [(-1, 0, 0), (-1, 0, 0), (1, n, 1), (1, n, 1)]


def test_empty_table(spark):
    assert op.digest(op.repeated_spans(documents(spark, [(1, "a")]).where("false"))).collect() == []


def test_merge_of_random_strings():
    rng = random.Random(8)
    for trial in range(60):
        width = rng.choice([4, 6, 8, 20, 40])
        texts = [bytes(rng.choices(b"ab" if trial % 2 else b"abcdefgh", k=rng.randint(width, width * 4))) for _ in range(rng.randint(1, 6))]
        seen = {}
        for d in texts:
            for p in range(len(d) - width + 1):
                seen[d[p : p + width]] = seen.get(d[p : p + width], 0) + 1
        got = op.repeated_starts(texts, np.ones(len(texts), int), width)
        assert [g.tolist() for g in got] == [[p for p in range(len(d) - width + 1) if seen[d[p : p + width]] > 1] for d in texts]


def test_common_prefixes_of_a_merge():
    """Common prefixes and suffix order of a merge equal those of sorted suffixes."""
    rng = random.Random(9)
    for _ in range(20):
        pieces = [bytes(rng.choices(b"ab", k=rng.randint(1, 30))) for _ in range(4)]
        char, piece, offset = op.characters(pieces, 1)
        rank = np.unique(char, return_inverse=True)[1].astype(np.int32)
        cut = int(np.flatnonzero(piece == 2)[0])
        a, b = op.transform(rank[:cut], offset[:cut], 0, 1, 4), op.transform(rank[cut:], offset[cut:], cut, 1, 4)
        merged, common = op.merge(a, b, 4)
        end = {p: i for i, p in enumerate(np.flatnonzero(rank == 0))}

        def chars(p):
            out = []
            while len(out) < 4 and p not in end:
                out.append((1, int(rank[p])))
                p += 1
            return out + [(0, end[p])] if p in end and len(out) < 4 else out

        suffixes = [chars(int(p)) for p in merged.place]
        assert suffixes == sorted(suffixes)
        same = lambda x, y: next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert common[1:].tolist() == [min(4, same(x, y)) for x, y in zip(suffixes[:-1], suffixes[1:])]
