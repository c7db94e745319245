import random

from helpers import documents, lorem, with_clashes
from sentimetry.llm import token_counts as op


def greedy(word, pieces):
    """Longest match first, piece by piece."""
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at + 1, -1) if word[at:e] in pieces), at + 1)
        at, n = end, n + 1
    return n


def test_random_vocabularies():
    rng = random.Random(1)
    for _ in range(150):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(rng.randint(0, 25))}
        automaton = op.LongestMatch(pieces)
        for _ in range(30):
            word = bytes(rng.choices(b"abcd", k=rng.randint(0, 20)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_texts_with_a_public_vocabulary(spark):
    rng = random.Random(2)
    vocabulary = op.read_vocabulary()
    pieces = set(vocabulary)
    texts = [lorem(rng, 50), "The of and Universität naïve 日本語 🙂", "internationalization antidisestablishmentarianism", None, "", "  \t\n", "x" * 5000, "a b"]
    want = [(i, len((t or "").encode().split()), sum(greedy(b" " + w, pieces) for w in (t or "").encode().split())) for i, t in enumerate(texts)]
    rows = [*enumerate(texts), (None, "no id"), (0, texts[0])]
    got = sorted(map(tuple, op.token_counts(with_clashes(documents(spark, rows)), vocabulary).collect()), key=repr)
    none = (None, 2, greedy(b" no", pieces) + greedy(b" id", pieces))
    assert got == sorted([*want, none, want[0]], key=repr)
    assert op.token_counts(documents(spark, rows).where("false"), vocabulary).collect() == []


def test_forgotten_words_are_counted_again(spark, monkeypatch):
    monkeypatch.setattr(op, "KEPT_WORDS", 3)
    docs = documents(spark, [(1, "aa bb cc dd ee aa bb dd ee")])
    assert op.token_counts(docs, [b" a", b" aa", b"b"]).collect()[0].n_tokens == 2 * 1 + 2 * 3 + 3 + 2 * 3 + 2 * 3
