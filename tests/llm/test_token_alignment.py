"""Operator 12 against whole texts aligned byte by byte, without cutting or memory."""

import hashlib
import random
from collections import Counter

import pytest

from sentimetry.llm import token_alignment as T

from helpers import documents, with_clashes


@pytest.fixture(scope="module")
def pair():
    return T.Pair(T.Alignment())


def whole(pair, text):
    """(A ids, B ids, groups, links) of one text by bytes, or None."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    owners = []
    for ids, of in ((a, lambda i: pair.bytes_a[i]), (b, lambda i: pair.bytes_b[i])):
        if b"".join(map(of, ids)) != raw:
            return None
        owners.append([k for k, i in enumerate(ids) for _ in of(i)])
    links = list(dict.fromkeys(zip(*owners)))
    groups, at = [[[], []]], 0
    ends = [{k for k in range(1, len(raw) + 1) if k == len(raw) or o[k] != o[k - 1]} for o in owners]
    for k in range(1, len(raw) + 1):
        if k in ends[0] & ends[1]:
            groups.append([[a[i] for i in dict.fromkeys(owners[0][at:k])], [b[i] for i in dict.fromkeys(owners[1][at:k])]])
            at = k
    return a, b, groups[1:], [(a[i], b[j]) for i, j in links]


def brute(pair, rows):
    done = [whole(pair, r[1]) for r in rows]
    count = Counter(link for x in done if x for link in x[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for r, x in zip(rows, done):
        if not x:
            out.append((r[0], 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((r[0], len(a), len(b), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, p=T.Alignment()):
    out = T.token_alignment(with_clashes(documents(spark, rows)), p)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


ODD = ["", None, " ", "  ", "   ", "a", " a ", "a  ", "\n", "a\n b", "a \n  b\t c", "x  y", "x　 y z", "it's we'll 've", "<|endoftext|> </s><s>", "a<unk>b",
       "under▁score", "▁", "日本語 テキスト", "naïve café", "emoji 👩‍👩‍👧 z", "\x00 a\x01b", "tab\t\ttab  two", "x᠎ y", "x\x1c y", "x\u0085 y", "é ́", "word " * 300, "z" * 3000, "12345 67 8,900.5", "﻿bom", "ﬁ ½ Ⅷ", "a\r\n b"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    signs = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "\t", "1", "23", "é", "ß", "日", "👍", "'s", "'", ".", "!!", " ", " ", "Ω", "\x1f", "-", "_", "http://", "A"]
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_cut_texts_align_as_whole_ones(pair):
    p = T.Alignment()
    for text in [x for x in ODD if x] + random_texts(600):
        want, (got, codes, numbers) = whole(pair, text), T.measures(pair, [text], p)[0]
        if want is None:
            assert got == T.NONE and not len(codes)
            continue
        a, b, groups, links = want
        assert got[:4] == (len(a), len(b), len(groups), len(links)), text
        assert dict(zip(codes.tolist(), numbers.tolist())) == Counter(x * pair.n_b + y for x, y in links), text
        assert got[4] == hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in groups).encode()).hexdigest()


@pytest.mark.parametrize("head", [400_000, 25, 0])
def test_against_whole_texts(spark, pair, head):
    texts = ODD + random_texts(60, 2) + ["the cat sat on the mat again and again"] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (3, "the cat"), (3, "the cat"), (None, None)]
    assert result(spark, rows, T.Alignment(head=head)) == brute(pair, rows)


def test_both_libraries_read_the_vocabulary_alike(pair, spark):
    texts = [x for x in ODD if x] + random_texts(400, 7) + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert pair.ids_a(" " + text) == pair.a.encode(" " + text, add_special_tokens=False).ids


def test_many_texts_at_once_and_in_turn(pair):
    texts = [x for x in ODD if x] + random_texts(200, 9)
    own = T.Pair(T.Alignment())
    together = T.measures(own, texts, T.Alignment(kept=20, kept_chars=4))
    assert len(own.groups) <= 20 and len(own.first) == len(own.groups) + 1
    for text, x in zip(texts, together):
        alone = T.measures(pair, [text], T.Alignment())[0]
        assert x[0] == alone[0] and x[1].tolist() == alone[1].tolist() and x[2].tolist() == alone[2].tolist()


def test_small_memory_and_no_rows(spark, pair):
    rows = [(i, t) for i, t in enumerate(random_texts(40, 3))]
    assert result(spark, rows, T.Alignment(kept=3, kept_chars=2, flush=10)) == brute(pair, rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_broken_bytes_have_no_tokens(spark):
    df = spark.sql("SELECT 1L AS doc_id, decode(X'61', 'utf-8') AS text UNION ALL SELECT 2L, CAST(X'61FF62' AS STRING)")
    rows = {r.doc_id: r.n_a for r in T.token_alignment(df).collect()}
    assert rows == {1: 1, 2: 0}


def test_real_documents(spark, pair):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id % 5 = 0").collect()]
    assert result(spark, rows) == brute(pair, rows)
