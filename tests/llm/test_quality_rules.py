import collections
import random
import re

import numpy as np
from helpers import documents, lorem, with_clashes
from sentimetry.llm import quality_rules as op


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again), failed


def prose(rng, n):
    words = [rng.choice(["the", "of", "and", "to", "in", "is"]) if rng.random() < 0.5 else f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmnprst')}{rng.randrange(10**4) // 500 * 'e'}" for _ in range(n)]
    return " ".join(w.title() if i % 9 == 0 else w + ("." if i % 9 == 8 else "") for i, w in enumerate(words))


def test_counts(spark):
    rng = random.Random(1)
    texts = [lorem(rng, rng.randrange(1, 200), 50) for _ in range(20)] + [lorem(rng, 30) + "\n" + "a b\n" * 5 + " \n\na b\r\n"]
    texts += [None, "", " \t ", "x " * 40, "é ü # | <b>\n" * 8, "a b c d e a b c d e f g h i j k", "one", "Orre " * 3000, "\n".join(["same line here"] * 4)]
    got = {r.doc_id: tuple(r)[1:7] for r in op.quality_rules(with_clashes(documents(spark, list(enumerate(texts))))).collect()}
    assert [got[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_verdicts(spark):
    rng = random.Random(2)
    good = [(i, prose(rng, rng.randrange(150, 400)), "en", "s") for i in range(150)]
    symbols = [(1000 + i, " ".join(f"{w}{rng.choice(['$$$', '%%%', '###'])}" for w in prose(rng, 200).split()), "en", "s") for i in range(5)]
    lists = [(2000 + i, " ".join(f"zq{rng.randrange(10**6)} |" for _ in range(150)), "en", "s") for i in range(5)]
    shout = [(3000 + i, prose(rng, 200).upper().replace(" ", "!! "), "en", "s") for i in range(5)]
    short = [(4000, prose(rng, 20) + " ###", "en", "s"), (4001, prose(rng, 200), None, "s")]  # too short to compare; alone in its language
    kept = {r.doc_id: r.kept for r in op.quality_rules(documents(spark, good + symbols + lists + shout + short)).collect()}
    assert all(kept[g[0]] for g in good) and kept[4000] and kept[4001]
    assert not any(kept[x[0]] for x in symbols + lists + shout)


def test_short_documents_shape_the_references(spark):
    """A language all of whose documents are under ``least_words`` is judged by its characters."""
    rng = random.Random(4)
    good = [(i, prose(rng, rng.randrange(100, 149)), "xx", "s") for i in range(60)]
    junk = [(1000 + i, " ".join(f"{rng.randrange(10**6)}$%#|" for _ in range(60)), "xx", "s") for i in range(3)]
    rows = documents(spark, good + junk + [(2000, "two words", "xx", "s"), (2001, "", "xx", "s")])
    got = {r.doc_id: r for r in op.quality_rules(rows).collect()}
    assert all(got[g[0]].kept for g in good)
    assert not any(got[x[0]].base_failed or got[x[0]].kept for x in junk)
    total = collections.Counter()
    for _, text, *_ in good + junk + [(0, "two words")]:
        own = collections.Counter("l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else " " if c == " " else "m" if c == "." else "o" for c in text)
        for c, k in own.items():
            total[c] += k / max(len(text), 400)
    shares = {x["word"]: x["share"] for x in op.references(rows.select("text", "lang")) if x["word"] < 0}
    for i, c in enumerate("lud mo"):
        assert abs(shares[-1 - i] / sum(shares.values()) - total[c] / sum(total.values())) < 1e-6


def test_same_twice_and_empty(spark):
    rng = random.Random(3)
    docs = documents(spark, [(i % 30, prose(rng, 200)) for i in range(40)] + [(None, None)])
    assert sorted(map(tuple, op.quality_rules(docs).collect()), key=repr) == sorted(map(tuple, op.quality_rules(docs.repartition(7)).collect()), key=repr)
    assert op.quality_rules(docs.where("false")).collect() == []


def test_js_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert op.js_distance(p, p) == 0 and abs(op.js_distance(p, q) - 1) < 1e-12
    a, b = np.array([0.7, 0.2, 0.1]), np.array([0.1, 0.3, 0.6])
    m = (a + b) / 2
    want = (((a * np.log2(a / m)).sum() + (b * np.log2(b / m)).sum()) / 2) ** 0.5
    assert abs(op.js_distance(a, b) - want) < 1e-12 and abs(op.js_distance(b, a) - want) < 1e-12
