"""Operator 13 against all pairs; signatures that must be shared; odd rows."""

import random
import re

import numpy as np

from sentimetry.llm import ngram_join as J
from sentimetry.llm.textbytes import Block

from helpers import documents, with_clashes


def shingle_set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, percent=90):
    sets = [shingle_set(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def up(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[up(i)] = up(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[up(i)] = min(r[0], least.get(up(i), r[0]))
    return sorted(((r[0], len(s), least.get(up(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def result(spark, rows, p=J.JaccardJoin()):
    out, _ = J.jaccard_join(with_clashes(documents(spark, rows)), p)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=str)


def prose(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"e{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"e{rng.randrange(10**6)}")
        elif len(words) > 3:
            del words[at]
    return words


def family_rows(seed=5):
    rng = random.Random(seed)
    rows = []
    for n in (3, 4, 9, 12, 25, 40, 90, 200, 600, 1500):
        for _ in range(4):
            base = prose(rng, n)
            for _ in range(6):
                rows.append((len(rows), " ".join(edited(rng, base, rng.randrange(0, max(2, n // 25))))))
    return rows


def test_against_all_pairs(spark):
    rows = family_rows()
    rows += [(r[0] + 5000, r[1].upper()) for r in rows[:40:7]]
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) - 50
    assert result(spark, rows) == want


def test_small_blocks_meet(spark):
    """Groups of many blocks: members that their leader doesn't link."""
    rng = random.Random(8)
    base = prose(rng, 120)
    rows = [(i, " ".join(edited(rng, base, rng.randrange(1, 5)))) for i in range(150)]
    assert result(spark, rows, J.JaccardJoin(elements=1500)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  b"), (5, "A  b"), (6, "a b c"), (7, "a"), (None, "a b c"), (None, "z z z z"),
            (8, "a " * 5000), (9, "a b c d"), (9, "x y z"), (10, "X\x0by z"), (11, "a b"), (12, "É a b"), (13, "é a b"), (2, "")]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 1)]


def test_every_linked_pair_shares_a_signature():
    rng, p = random.Random(2), J.JaccardJoin()
    pairs = 0
    for _ in range(800):
        base = prose(rng, rng.choice([5, 10, 11, 13, 19, 25, 33, 60, 130, 400, 2000]))
        x, y = (" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 30 + 1))) for _ in range(2))
        a, b = shingle_set(x), shingle_set(y)
        if 100 * len(a & b) < 90 * len(a | b):
            continue
        pairs += 1
        h, text = J.shingle_sets(Block([x.encode(), y.encode()]), 3)
        node, size = J._nodes(h, text, 2)
        signature, owner = J.signatures(h, text, size, node, p)
        assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist()), (len(a), len(b))
    assert pairs > 150


def test_worst_differences_still_share_a_signature():
    """As many differences as the threshold allows, at every size and band edge."""
    rng, p = np.random.default_rng(4), J.JaccardJoin()
    for a in [*range(1, 60), 99, 100, 101, 180, 345, 1000]:
        for b in {a, a * 10 // 9, (a * 100 + 89) // 90, a + 1}:
            common = J.least_common(a, b, 90)
            if common > min(a, b):
                continue
            for _ in range(3):
                pool = rng.integers(0, 1 << 63, a + b - common).astype(np.uint64)
                x, y = np.sort(pool[:a]), np.sort(np.concatenate([pool[:common], pool[a:]]))
                h, text = np.concatenate([x, y]), np.repeat([0, 1], [a, b])
                node, size = J._nodes(h, text, 2)
                signature, owner = J.signatures(h, text, size, node, p)
                assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist()), (a, b)


def test_signatures_per_element():
    p = J.JaccardJoin()
    h = np.arange(1, 1001, dtype=np.uint64)
    node, size = J._nodes(h, np.zeros(1000, np.int64), 1)
    signature, _ = J.signatures(h, np.zeros(1000, np.int64), size, node, p)
    assert len(signature) == len(set(signature.tolist())) < 500


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    p = J.JaccardJoin()
    sets = [np.unique(rng.integers(0, 3000, 200).astype(np.uint64)) for _ in range(20)]
    parity = J._parities(sets, p)
    for i in range(20):
        for j in range(i):
            assert np.bitwise_count(parity[i] ^ parity[j]).sum() <= len(np.setxor1d(sets[i], sets[j]))
