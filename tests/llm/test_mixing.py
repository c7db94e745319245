import math
import random
import re

from helpers import documents, lorem, with_clashes
from sentimetry.llm import mixing as op


def water_filling(sizes, weights=(5, 2, 1), most=3.0):
    """Targets by repeated sharing, as the contract says it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        above = {s for s in names if s not in capped and target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def corpus(rng):
    rows = []
    for source, n, longest in (("b", 400, 300), ("a", 30, 40), ("é", 200, 900), ("B", 150, 100), (None, 80, 200), ("z", 60, 500)):
        rows += [(len(rows) + i, lorem(rng, rng.randrange(0, longest)), "en", source) for i in range(n)]
    rows += [(9000, "word " * 4000, "en", "b"), (9001, None, "en", "b"), (9002, None, "en", "empty"), (9003, "", "en", "empty")]
    rows += [rows[3], rows[3], (None, "no id here", "en", "b"), (None, "no id here", "en", "b")]
    return rows


def test_targets_copies_and_reruns(spark):
    rows = corpus(random.Random(1))
    docs = with_clashes(documents(spark, rows))
    got = op.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = water_filling(sizes)
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, _, _ in rows)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-9) for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= max(3, 0.01 * want[source]), source
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
    again = op.mix(docs.repartition(9)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_rates_are_exponential_tilts(spark):
    """Rates of a source are min(3, exp(dual * size / mean)) with one dual."""
    got = op.mix(documents(spark, corpus(random.Random(2)))).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source and r.size and 0.05 < r.rate < 2.999]
        duals = [math.log(r.rate) / r.size for r in own if abs(math.log(r.rate)) > 0.05]
        assert not duals or max(duals) - min(duals) < 2e-2 * abs(max(duals, key=abs)) + 1e-9


def test_balance_minimises_divergence(spark):
    """No feasible shift of rate between two documents lowers the divergence."""
    got = [r for r in op.mix(documents(spark, corpus(random.Random(3)))).collect() if r.source == "b" and 0.05 < r.rate < 2.9 and r.size]
    cost = lambda r: r * math.log(r) - r + 1
    a, b = min(got, key=lambda r: r.size), max(got, key=lambda r: r.size)
    for step in (1e-3, -1e-3):
        assert cost(a.rate + step / a.size) + cost(b.rate - step / b.size) >= cost(a.rate) + cost(b.rate) - 1e-8


def test_one_source_and_empty_table(spark):
    docs = documents(spark, [(i, "a b c") for i in range(5)])
    assert [r.copies for r in op.mix(docs).collect()] == [1] * 5
    assert op.mix(docs.where("false")).collect() == []


def test_mixed_documents(spark):
    rows = corpus(random.Random(4))
    docs = documents(spark, rows)
    mixed = op.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "copies"]
    assert sorted((r.doc_id or -1, r.copies) for r in mixed.collect()) == sorted((r.doc_id or -1, r.copies) for r in op.mix(docs).collect() if r.copies)
