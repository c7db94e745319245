"""Operator 11: exact centroid clustering with ns-bounds.

Vectors are integer points; a round assigns every point to its nearest centroid
and moves each centroid to the floor of its points' mean.  A point keeps, for
each centroid, the distance last computed and the round of it.  Distances are
loosened by the norm of the centroid's total displacement since that round,
looked up in the history of centroids, not by the sum of its steps: a centroid
that comes back loosens nothing.  A centroid whose loosened distance can't reach
the point's own is left out; the others are computed exactly, in integers, so
bounds only save work and never decide a tie.

On Spark a round is one map over the points with the history in its closure
(rounds x centroids x components, cut to ``history`` rounds by rebasing the
bounds), a written table of points and bounds, and sums that each task adds up
first: a row per task and centroid is shuffled, whatever a cluster's size.

Defined results: vectors that are null, of another length, or with a null or
non-finite component are left out; a null id hashes last; repeated rows are
points of their own; of starting points with one hash the lesser vector comes
first; with fewer points than centroids there are as many centroids as points;
an empty table gives no rows.  A component of 2**27 or more after scaling is an
error: its squared distance is no long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

LARGEST = 1 << 27  # of a component
IN_FLOATS = 1 << 22  # up to here sums of 64 products are exact in floats
MARGIN = 1e-9


@dataclass(frozen=True)
class NsBounds:
    """``history``: rounds of centroids kept before bounds are rebased."""

    k: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    history: int = 32


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` and one centroid ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < IN_FLOATS:
        step = x.astype(np.float64) - c
        return np.einsum("ij,ij->i", step, step).astype(np.int64)
    step = x - c
    return np.einsum("ij,ij->i", step, step)


def assign(x: np.ndarray, cluster: np.ndarray | None, last: np.ndarray | None, seen: np.ndarray | None, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, last, seen, distances computed) after the newest centroids of
    ``past`` (rounds x centroids x components).  ``last[i, j]``: distance of point i
    and centroid j as it was in round ``seen[i, j]``."""
    now, k = len(past) - 1, past.shape[1]
    if cluster is None:
        exact = np.stack([squared(x, c) for c in past[now]], axis=1)
        return exact.argmin(axis=1), np.sqrt(exact.astype(np.float64)), np.full((len(x), k), now, np.int16), exact.size
    moved = np.sqrt(((past[now] - past).astype(np.float64) ** 2).sum(axis=2))  # norm of the total displacement since each round
    far = last - moved[seen, np.arange(k)] * (1 + MARGIN)
    here = np.arange(len(x))
    own = last[here, cluster] + moved[seen[here, cluster], cluster] * (1 + MARGIN)
    reach = lambda d: far <= (d * (1 + MARGIN) + MARGIN)[:, None]
    far[here, cluster] = np.inf
    last, seen, computed = last.copy(), seen.copy(), 0

    def measure(rows: np.ndarray, j: int) -> np.ndarray:
        nonlocal computed
        exact = squared(x[rows], past[now, j])
        last[rows, j], seen[rows, j] = np.sqrt(exact.astype(np.float64)), now
        computed += len(rows)
        return exact

    best = np.zeros(len(x), np.int64)
    open_ = reach(own).any(axis=1)
    for j in range(k):
        rows = np.flatnonzero(open_ & (cluster == j))
        best[rows] = measure(rows, j)
    fails = reach(np.where(open_, last[here, cluster], -1.0)) & open_[:, None]
    to = cluster.copy()
    for j in range(k):
        rows = np.flatnonzero(fails[:, j])
        exact = measure(rows, j)
        nearer = (exact < best[rows]) | ((exact == best[rows]) & (j < to[rows]))
        to[rows[nearer]], best[rows[nearer]] = j, exact[nearer]
    return to, last, seen, computed


def rebased(x: np.ndarray, cluster: np.ndarray, last: np.ndarray, seen: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that refer to the newest centroids alone, as round 0."""
    moved = np.sqrt(((past[-1] - past).astype(np.float64) ** 2).sum(axis=2))
    loose = np.maximum(last - moved[seen, np.arange(past.shape[1])] * (1 + MARGIN), 0)
    for j in range(past.shape[1]):
        rows = np.flatnonzero(cluster == j)
        loose[rows, j] = np.sqrt(squared(x[rows], past[-1, j]).astype(np.float64))
    return loose, np.zeros_like(seen)


STATE = "vec_id long, point binary, cluster int, last binary, seen binary"


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.itemsize * (rows.shape[1] if rows.ndim > 1 else 1))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _points(p: NsBounds):
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(np.asarray(batch.column("vector").flatten(), np.float64) * p.scale)
            if np.abs(x).max(initial=0) >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more after scaling: its squared distance is no long")
            yield pa.record_batch([batch.column("vec_id"), _binary(x.astype(np.int32).reshape(-1, p.dimensions))], names=["vec_id", "point"])

    return points


def _round(p: NsBounds, past: np.ndarray, first: bool, rebase: bool):
    k = past.shape[1]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("point"), np.int32, p.dimensions).astype(np.int64)
            state = (None, None, None) if first else (np.asarray(batch.column("cluster"), np.int64), _matrix(batch.column("last"), np.float64, k), _matrix(batch.column("seen"), np.int16, k))
            cluster, last, seen, _ = assign(x, *state, past)
            if rebase:
                last, seen = rebased(x, cluster, last, seen, past)
            yield pa.record_batch([batch.column("vec_id"), batch.column("point"), pa.array(cluster.astype(np.int32)), _binary(last), _binary(seen)], names=[c.split()[0] for c in STATE.split(", ")])

    return step


def _sums(p: NsBounds):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((p.k, p.dimensions), np.int64), np.zeros(p.k, np.int64)
        for batch in batches:
            x, cluster = _matrix(batch.column("point"), np.int32, p.dimensions), np.asarray(batch.column("cluster"))
            for j in np.unique(cluster):
                rows = cluster == j
                total[j] += x[rows].sum(axis=0, dtype=np.int64)
                count[j] += rows.sum()
        have = np.flatnonzero(count)
        yield pa.record_batch([pa.array(have.astype(np.int32)), pa.array(count[have]), pa.array(list(total[have]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return sums


def _distances(p: NsBounds, centroids: np.ndarray):
    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = _matrix(batch.column("point"), np.int32, p.dimensions).astype(np.int64), np.asarray(batch.column("cluster"))
            out = np.zeros(len(x), np.int64)
            for j in np.unique(cluster):
                rows = np.flatnonzero(cluster == j)
                out[rows] = squared(x[rows], centroids[j])
            yield pa.record_batch([batch.column("vec_id"), batch.column("cluster"), pa.array(out)], names=["vec_id", "cluster", "distance"])

    return distances


def kept_vectors(vectors: DataFrame, p: NsBounds = NsBounds()) -> DataFrame:
    """(vec_id, vector array<double>) of ``vectors`` (vec_id, embedding) that can be clustered."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("vector") == p.dimensions) & fine)


def cluster_vectors(vectors: DataFrame, p: NsBounds = NsBounds()) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each kept vector, and the final centroids."""
    kept = kept_vectors(vectors, p)
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(digest.asc_nulls_last(), "vector").limit(p.k).select("vector").collect()  # k rows
    centroids = np.floor(np.array([r.vector for r in start], np.float64).reshape(-1, p.dimensions) * p.scale)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, p.dimensions), np.int64)
    state = kept.mapInArrow(_points(p), "vec_id long, point binary")
    past = centroids.astype(np.int64)[None]
    for n in range(p.rounds + 1):
        rebase = len(past) >= p.history
        state = stored(state.mapInArrow(_round(p, past, n == 0, rebase), STATE), "ns-bounds")
        if rebase:
            past = past[-1:]
        if n == p.rounds:
            break
        parts = state.select("point", "cluster").mapInArrow(_sums(p), "cluster int, n long, total array<long>")
        each = parts.select("cluster", "n", F.posexplode("total").alias("i", "part"))
        means = each.groupBy("cluster", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()  # k x dimensions rows
        moved = past[-1].copy()
        for r in means:
            moved[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
        past = np.concatenate([past, moved[None]])
    return state.select("vec_id", "point", "cluster").mapInArrow(_distances(p, past[-1]), "vec_id long, cluster int, distance long"), past[-1]


def digest(vectors: DataFrame, p: NsBounds = NsBounds()) -> DataFrame:
    """Each kept vector's cluster and distance, inertias, and the centroid's digest."""
    points, centroids = cluster_vectors(vectors, p)
    points = stored(points, "clusters") if len(centroids) else points
    wide = {r["cluster"]: int(r["s"]) for r in points.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    by = points.sparkSession.createDataFrame([(j, wide[j], sum(wide.values()), sha[j]) for j in wide], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return points.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustering_sql(p: NsBounds = NsBounds()) -> str:
    """The same in SQL, every distance computed."""
    nearest = "SELECT row, argmin(j, (d, j)) AS j, min(d) AS d FROM (SELECT p.row, c.j, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM points p, {c} c) GROUP BY row"
    steps = [f"""points AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({p.scale} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {p.dimensions} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS j, x FROM points ORDER BY sha256('1:' || vec_id), x LIMIT {p.k})"]
    for n in range(p.rounds):
        steps += [f"a{n} AS MATERIALIZED ({nearest.format(c=f'c{n}')})",
                  f"""m{n} AS MATERIALIZED (SELECT j, list(m ORDER BY i) AS x FROM (SELECT j, i, ((s - ((s % n) + n) % n) // n)::BIGINT AS m FROM (
  SELECT j, i, sum(v) AS s, count(*) AS n FROM (SELECT a.j, unnest(p.x) AS v, unnest(range({p.dimensions})) AS i FROM a{n} a JOIN points p USING (row)) GROUP BY j, i)) GROUP BY j)""",
                  f"c{n + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m USING (j))"]
    last = f"c{p.rounds}"
    return "WITH " + ",\n".join(steps) + f""",
e AS MATERIALIZED ({nearest.format(c=last)})
SELECT p.vec_id, e.j::INT AS cluster, e.d AS distance, (sum(e.d) OVER (PARTITION BY e.j))::BIGINT AS cluster_inertia, (sum(e.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM e JOIN points p USING (row) JOIN {last} c ON c.j = e.j"""
