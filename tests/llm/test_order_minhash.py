import random
import re

import numpy as np
from helpers import documents, lorem, with_clashes
from sentimetry.llm import order_minhash as op


def shingles(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def chain(a, b):
    """Longest common subsequence, by the full table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def brute(texts):
    """Class (least index) of each text, by all pairs."""
    s = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if s[i] == s[j]:
                same = True
            elif not s[i] or not s[j] or not set(s[i]) & set(s[j]):
                same = False
            else:
                m = chain(s[i], s[j])
                same = m / (len(s[i]) + len(s[j]) - m) >= 0.8
            if same:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def classes(spark, texts):
    got, _ = op.near_duplicates(with_clashes(documents(spark, list(enumerate(texts)))))
    return {r.doc_id: r.class_id for r in got.collect()}


def test_classes_against_all_pairs(spark):
    rng = random.Random(3)
    passage = lorem(rng, 30)
    texts = [lorem(rng, rng.randrange(20, 150)) for _ in range(15)]
    for base in [lorem(rng, 150, 10**6) for _ in range(6)]:
        texts += [base] + [edited(rng, base, rng.choice([0, 1, 2, 8])) for _ in range(4)] + [base.upper(), base.replace(" ", ", ")]
    texts += [lorem(rng, 60, 10**6) + " " + passage for _ in range(10)]
    texts += [None, "", " .. ", "one two", "One two.", "one two three", "Orre " * 60, "Orre " * 61, "Orre " * 30]
    words = texts[20].split()
    texts.append(" ".join(words[75:] + words[:75]))  # moved text is no near copy
    rng.shuffle(texts)
    got = classes(spark, texts)
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_star_of_variants(spark):
    """Variants that only their original links: it is neither leader nor next to all of them."""
    rng = random.Random(4)
    base = lorem(rng, 200, 10**6)
    texts = [edited(rng, base, 3) for _ in range(150)]
    texts.insert(90, base)
    got = classes(spark, texts)
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_family_around_the_threshold(spark):
    """One template of 270 shingles with 12 slots, alike when 6 slots agree or more:
    the few links of a text are anywhere in its buckets, which hold hundreds."""
    rng = random.Random(8)
    slots = [[rng.randrange(6) for _ in range(12)] for _ in range(300)]
    texts = []
    for own in slots:
        words = [f"t{i}" for i in range(274)]
        for k, v in enumerate(own):
            words[15 + 20 * k] = f"s{k}v{v}"
        texts.append(" ".join(words))
    root = list(range(len(slots)))
    for i in range(len(slots)):
        for j in range(i):
            if root[i] != root[j] and sum(map(int.__eq__, slots[i], slots[j])) >= 6:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got, _ = op.near_duplicates(documents(spark, list(enumerate(texts))))
    got = {r.doc_id: r.class_id for r in got.collect()}
    assert len(set(root)) == 31 and [got[i] for i in range(len(texts))] == root


def test_repeated_rows_null_ids_and_empty_table(spark):
    rng = random.Random(5)
    a, b = lorem(rng, 50), lorem(rng, 50)
    docs = documents(spark, [(4, a), (4, a), (None, a), (None, b), (2, None), (3, "")])
    got, _ = op.near_duplicates(docs)
    rows = sorted(((r.doc_id, r.class_id) for r in got.collect()), key=str)
    assert rows == sorted([(4, 4), (4, 4), (None, 4), (None, None), (2, 2), (3, 2)], key=str)
    assert op.near_duplicates(docs.where("false"))[0].collect() == []


def test_alignment_equals_the_full_table():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(12) for _ in range(rng.randrange(1, 30))]
        b = a[:] if rng.random() < 0.7 else [rng.randrange(12) for _ in range(20)]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(12))
        m = chain(a, b)
        want = m / (len(a) + len(b) - m)
        got = op.similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
        assert got == (want if want >= 0.8 else 0.0)


def test_order_matters_in_samples():
    rng = np.random.default_rng(0)
    label = rng.integers(1, 2**63, 100).astype(np.uint64)
    text = np.zeros(100, np.int64)
    p = op.NearDuplicates(sketches=400)
    same = op.order_samples(label, text, p) == op.order_samples(label[::-1].copy(), text, p)
    assert same.mean() < 0.02  # equal sets in reverse order
    few = label.copy()
    few[50] = 7
    assert 0.88 < (op.order_samples(label, text, p) == op.order_samples(few, text, p)).mean() < 0.99


def test_joining_pairs_of_two_blocks():
    """In-task comparison: sides meet each other only, and links join components."""
    import random

    import numpy as np

    from sentimetry.llm import order_minhash as O
    from sentimetry.llm.textbytes import Block

    p, rng = O.NearDuplicates(), random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    texts = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in (10, 60, 110, 160)] + [" ".join(f"z{rng.randrange(500)}" for _ in range(200))]
    word, text = O.words_of(Block([t.encode() for t in texts]))
    words = [x.tobytes() for x in np.split(word, np.searchsorted(text, np.arange(1, len(texts))))]
    shingle, owner = O.shingles(word, text, len(texts), p.shingle)
    bits = O.sketch_bits(O.labelled(shingle, owner), owner, len(texts))
    size = np.bincount(owner)
    one = O.joined(words, size, bits, np.arange(5), np.zeros(5, int), p)
    assert [x[:2] for x in one] == [(0, 1), (0, 2), (0, 3)] and all(x[2] >= p.threshold for x in one)
    two = O.joined(words, size, bits, np.arange(5), np.array([0, 0, 1, 1, 1]), p)
    assert {x[:2] for x in two} == {(0, 2), (0, 3), (1, 2)}
    assert O.joined(words, size, bits, np.array([7, 7, 7, 7, 8]), np.zeros(5, int), p) == []
