"""Operator 11 against brute force, odd vectors, and the bounds themselves."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentimetry.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, p):
    points = [(i, np.floor(np.array(v, float) * p.scale).astype(object)) for i, v in rows if v is not None and len(v) == p.dimensions and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), list(r[1]))
    cents = [x for _, x in sorted(points, key=key)[: p.k]]
    near = lambda x: min(((x - c) @ (x - c), j) for j, c in enumerate(cents))
    for _ in range(p.rounds):
        to = [near(x)[1] for _, x in points]
        for j in range(len(cents)):
            own = [x for (_, x), a in zip(points, to) if a == j]
            if own:
                cents[j] = np.array([sum(c) // len(own) for c in zip(*own)], object)
    out = [(i, *near(x)[::-1]) for i, x in points]
    sums = {j: sum(d for _, a, d in out if a == j) for _, j, _ in out}
    sha = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, int(d), int(sums[j]), int(sum(sums.values())), sha[j]) for i, j, d in out)


def result(spark, rows, p):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("x") for c in ("cluster", "point", "last", "vector", "distance")})
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in C.digest(df, p).collect())


@pytest.mark.parametrize("rounds,history", [(3, 32), (7, 3)])
def test_against_brute_force(spark, rounds, history):
    rng = random.Random(rounds)
    p = C.NsBounds(k=5, rounds=rounds, dimensions=6, scale=8, history=history)
    rows = [(i, [rng.gauss(3 * (i % 4), 1.5) for _ in range(6)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[7][1]), (500, [0.0] * 6), (None, [1.0] * 6), (None, [1.0] * 6)]  # repeats, ties, null ids
    rows += [(501, None), (502, [1.0] * 5), (503, [None] + [1.0] * 5), (504, [float("nan")] + [1.0] * 5), (505, [float("-inf")] + [0.0] * 5), (506, [])]
    assert result(spark, rows, p) == brute(rows, p)


def test_few_and_no_vectors(spark):
    p = C.NsBounds(k=5, rounds=2, dimensions=2)
    rows = [(1, [0.5, -0.01]), (2, [0.5, -0.01]), (3, [9.0, 9.0])]
    assert result(spark, rows, p) == brute(rows, p)
    assert result(spark, [(4, None)], p) == []
    assert result(spark, [], p) == []


def test_wide_components_stay_exact(spark):
    p = C.NsBounds(k=2, rounds=2, dimensions=2, scale=1)
    rows = [(i, [float((1 << 26) + i), -float(1 << 26) + 3 * i]) for i in range(9)]
    assert result(spark, rows, p) == brute(rows, p)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-60, 60, (400, 8)) + 300 * rng.integers(0, 4, (400, 1)), np.zeros((40, 8), np.int64)]).astype(np.int64)
    past, state, work = x[:6][None].copy(), (None, None, None), []
    for _ in range(8):
        cluster, last, seen, computed = C.assign(x, *state, past)
        exact = ((x[:, None] - past[-1][None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all()
        moved = np.sqrt(((past[-1] - past) ** 2).sum(axis=2))
        assert (last - moved[seen, np.arange(6)] <= np.sqrt(exact) + 1e-6).all()
        state = (cluster, last, seen)
        work.append(computed)
        past = np.concatenate([past, np.stack([x[cluster == j].sum(axis=0) // max(1, (cluster == j).sum()) if (cluster == j).any() else past[-1, j] for j in range(6)])[None]])
    assert work[0] == x.shape[0] * 6 and min(work[1:]) < work[0] / 3


def test_displacement_is_not_summed():
    """A centroid that moved away and came back loosens nothing."""
    x = np.array([[0, 0], [100, 0]], np.int64)
    at = lambda b: np.array([[0, 0], b], np.int64)
    cluster, last, seen, _ = C.assign(x, None, None, None, np.stack([at([100, 0])]))
    _, _, _, computed = C.assign(x, cluster, last, seen, np.stack([at([100, 0]), at([190, 0]), at([100, 0])]))
    assert computed == 0


def test_sql_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    p = C.NsBounds()
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = sorted(map(str, con.execute(C.clustering_sql(p)).fetchall()))
    got = C.digest(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"), p).collect()
    assert sorted(str(tuple(r)) for r in got) == want
