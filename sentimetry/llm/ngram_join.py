"""Operator 13: n-gram Jaccard join by PartEnum signatures.

A text is its set of distinct ``shingle``-word sequences (A-Z lower-cased; fewer
words: the whole sequence).  Sizes are cut into bands; in a band, sets as alike
as the threshold differ in at most k = (100 - t) / (100 + t) x 2 x (band's
largest size) elements.  The feature domain is dealt by hash into ceil((k+1)/2)
partitions, so some partition holds at most one of these k differences, and each
partition into three parts: of the three subsets that leave one part out, at
least one is equal in both sets.  Each (band, partition, subset) with the hash
of what the set has in it is a signature; two sets that may link share one.  A
set near the next band's sizes has signatures of that band too.

On Spark: a map makes signatures, one shuffle brings equal ones together, and a
signature's sets are put under its least set, the leader, so a family that
shares hundreds of signatures is a few groups and no pair is emitted.  First
each set meets its leader and the sets in the same block of the group; then, in
groups that still hold several components, all blocks meet.  A block is bounded
by its elements, compares its sets by parity bits, which never exceed the true
difference, then exactly, and returns only links that join components; pairs of
one component need no comparison.  Components come from hooking and contraction.

Defined results: null is empty, and texts without a word link with nothing;
repeated rows and texts of equal sets are linked; rows with one id and other
texts are rows of their own; a null id never is a component's id unless the
component has no other; an empty table gives no rows.  Hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import stored
from .textbytes import WHITE_SPACE, Block, blocks, mix

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class JaccardJoin:
    """``percent``: link when 100 x intersection >= percent x union; ``ratio``:
    of a band's largest to its smallest size, in tenths; ``elements``: of all
    sets in a block, about."""

    shingle: int = 3
    percent: int = 90
    ratio: int = 13
    elements: int = 500_000


def least_common(a, b, percent: int):
    """Smallest intersection with which sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def bands(largest: int, p: JaccardJoin) -> np.ndarray:
    """First sizes of the bands up to one beyond ``largest``."""
    edge = [1]
    while edge[-1] <= largest:
        edge.append(max(edge[-1] + 1, edge[-1] * p.ratio // 10))
    return np.array([*edge, max(edge[-1] + 1, edge[-1] * p.ratio // 10)])


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's distinct shingles, by text, then hash."""
    block.lower()
    start, end, text = block.words(WHITE_SPACE)
    word = block.hashes(start, end)
    last = np.searchsorted(text, np.arange(len(block)), side="right")[text] - 1
    here = np.arange(len(word))
    out = np.full(len(word), 1, np.uint64)
    for j in range(width):
        inside = np.flatnonzero(here + j <= last)
        out[inside] = mix(out[inside] * _STEP + word[inside + j])
    first = np.ones(len(word), bool)
    first[1:] = text[1:] != text[:-1]
    full = (here + width - 1 <= last) | first
    out, text = out[full], text[full]
    order = np.argsort(out)
    order = order[np.argsort(text[order].astype(np.uint16 if len(block) < 1 << 16 else np.int64), kind="stable")]
    out, text = out[order], text[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[new], text[new]


def signatures(h: np.ndarray, text: np.ndarray, size: np.ndarray, node: np.ndarray, p: JaccardJoin) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of non-empty sets; ``h`` and ``text``: their elements, by text."""
    out, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    edge = bands(int(size.max(initial=0)), p)
    band = np.searchsorted(edge, size, side="right") - 1
    reach = band.copy()
    high, low = mix(h + np.uint64(0x632BE59BD9B4E019)), mix(h ^ np.uint64(0xD1B54A32D192ED03))
    third = (low >> np.uint64(32)) % np.uint64(3)
    while True:
        live = (size > 0) & ((reach == band) | (100 * size >= p.percent * edge[np.minimum(reach, len(edge) - 1)])) & (reach < len(edge) - 1)
        if not live.any():
            return np.concatenate(out), np.concatenate(owner)
        most = edge[np.minimum(reach + 1, len(edge) - 1)] - 1
        differ = (100 - p.percent) * 2 * most // (100 + p.percent)
        same = np.flatnonzero(live & (differ == 0))  # only equal sets link
        out.append(mix(node[same] + reach[same].astype(np.uint64) * _STEP))
        owner.append(same)
        live &= differ > 0
        parts = np.where(live, differ // 2 + 1, 0)  # ceil((differ + 1) / 2)
        at = np.cumsum(parts) - parts
        mine = np.flatnonzero(live[text])
        t = text[mine]
        part = ((high[mine] >> np.uint64(32)) * parts[t].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        cell = np.zeros(int(parts.sum()) * 3, np.uint64)
        np.add.at(cell, (at[t] + part) * 3 + third[mine].astype(np.int64), mix(h[mine] * _STEP))
        cell = mix(cell.reshape(-1, 3) + np.arange(1, 4, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        of = np.repeat(np.arange(len(size)), parts)
        place = (reach[of] * (1 << 24) + np.arange(len(of)) - at[of]).astype(np.uint64) * np.uint64(4)
        for left_out in range(3):
            out.append(mix(cell[:, (left_out + 1) % 3] + cell[:, (left_out + 2) % 3] + mix(place + np.uint64(left_out))))
            owner.append(of)
        reach = np.where(size > 0, reach + 1, reach)
        reach[(size > 0) & (reach < len(edge)) & (100 * size < p.percent * edge[np.minimum(reach, len(edge) - 1)])] = len(edge)


def _nodes(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = np.bincount(text, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, text, mix(h))
    return mix(total + size.astype(np.uint64) * _STEP), size


SKETCHES = "doc_id long, key long, node long, n_shingles long, signatures array<long>"


def _sketch(p: JaccardJoin):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # sets whose signatures this task has given
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                n = len(block)
                h, text = shingle_sets(block, p.shingle)
                node, size = _nodes(h, text, n)
                fresh = np.zeros(n, bool)
                for i in np.flatnonzero(size).tolist():
                    if (x := int(node[i])) not in done:
                        fresh[i] = True
                        done.add(x)
                kept = fresh[text]
                signature, owner = signatures(h[kept], text[kept], np.where(fresh, size, 0), node, p)
                signature = signature[np.argsort(owner, kind="stable")]
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
                rows = batch.slice(at, n)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(signature.view(np.int64)))
                yield pa.record_batch([rows.column("doc_id"), rows.column("key"), pa.array(node.view(np.int64)), pa.array(size.astype(np.int64)), lists], names=[c.split()[0] for c in SKETCHES.split(", ")])

    return sketch


def _sets(p: JaccardJoin):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                h, text = shingle_sets(block, p.shingle)
                parts = np.split(h, np.searchsorted(text, np.arange(1, len(block))))
                yield pa.record_batch([batch.slice(at, len(block)).column("node"), pa.array([x.tobytes() for x in parts], pa.binary())], names=["node", "elements"])

    return sets


def _parities(sets: list[np.ndarray], p: JaccardJoin) -> np.ndarray:
    """Bit b of a set: whether an odd number of its elements hash to b.  Sets
    that differ in d elements differ in d bits at most."""
    size = np.array([len(s) for s in sets])
    bits = max(64, 1 << int(16 * (100 - p.percent) * 2 * size.max() // (100 + p.percent)).bit_length())
    flat = np.repeat(np.arange(len(sets)) * bits, size) + (np.concatenate(sets) & np.uint64(bits - 1)).astype(np.int64)
    odd = (np.bincount(flat, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), bits), axis=1).view(np.uint64)


def joined(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, p: JaccardJoin) -> list[tuple[int, int]]:
    """Pairs that link and join components, of all pairs of different sides (one
    side only: of all pairs).  ``root``: components so far."""
    size = np.array([len(s) for s in sets])
    parity = _parities(sets, p)
    of = np.unique(root, return_inverse=True)[1]
    across, links = side.min() != side.max(), []
    for i in range(len(sets) - 1):
        rest = np.arange(i + 1, len(sets))
        rest = rest[(of[rest] != of[i]) & (100 * np.minimum(size[rest], size[i]) >= p.percent * np.maximum(size[rest], size[i]))]
        if across:
            rest = rest[side[rest] != side[i]]
        if not len(rest):
            if not across and (of == of[0]).all():
                break
            continue
        apart = np.bitwise_count(parity[rest] ^ parity[i]).sum(axis=1, dtype=np.int64)
        both = size[rest] + size[i]
        for j in rest[apart <= both - 2 * least_common(size[rest], size[i], p.percent)].tolist():
            if of[j] == of[i]:
                continue
            place = np.searchsorted(sets[i], sets[j])
            common = int((sets[i][np.minimum(place, size[i] - 1)] == sets[j]).sum())
            if common >= least_common(int(size[i]), int(size[j]), p.percent):
                links.append((i, j))
                of[of == of[j]] = of[i]
    return links


def _compare(p: JaccardJoin):
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "side", "node", "root", "elements")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in groupby(rows(batches), key=lambda r: r[:3]):
            _, _, _, side, node, root, elements = zip(*block)
            links = joined([np.frombuffer(e, np.uint64) for e in elements], np.array(root), np.array(side), p) if len(node) > 1 else []
            if links:
                yield pa.record_batch([pa.array([node[a] for a, _ in links], pa.int64()), pa.array([node[b] for _, b in links], pa.int64())], names=["a", "b"])

    return compare


def jaccard_join(docs: DataFrame, p: JaccardJoin = JaccardJoin()) -> tuple[DataFrame, DataFrame]:
    """(rows, links) of ``docs`` (doc_id, text).  rows: doc_id, key (of id and
    text), n_shingles, node (of the set), root (of its component) and
    component_id; links (a, b) between nodes: enough to join each component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    sketches = stored(docs.mapInArrow(_sketch(p), SKETCHES), "signatures")
    rows = sketches.select("doc_id", "key", "node", "n_shingles")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.first("n_shingles").alias("n"))

    shared = "min(node) OVER (PARTITION BY signature)"
    bucket = sketches.select("node", F.explode("signatures").alias("signature")).select("node", F.expr(shared).alias("leader"), F.expr(shared.replace("min", "max")).alias("last"))
    groups = stored(bucket.where("leader < last").groupBy("leader", "node").agg(F.count("*").alias("shared")).join(nodes.select("node", "key", "n"), "node"), "groups")
    members = groups.groupBy("node").agg(F.first("key").alias("key"))
    # the same plan at every size: texts are shuffled once, never by a broadcast that only small inputs get
    sets = stored(docs.join(members.hint("merge"), "key").dropDuplicates(["node"]).select("node", "text").mapInArrow(_sets(p), "node long, elements binary"), "sets")

    def compared(blocks: DataFrame) -> DataFrame:
        """``blocks``: leader, i, j, side, node, root."""
        dealt = blocks.join(sets, "node").select("leader", "i", "j", "side", "node", "root", "elements").repartition("leader", "i", "j")
        return stored(dealt.sortWithinPartitions("leader", "i", "j", F.col("node") != F.col("leader"), "side", "node").mapInArrow(_compare(p), "a long, b long"), "links")

    def dealt(members: DataFrame) -> DataFrame:
        many = members.groupBy("leader").agg(F.ceil(F.sum("n") / p.elements).alias("blocks"))
        return members.join(many, "leader").withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))

    own = groups.where("node <> leader").groupBy("node").agg(F.max(F.struct("shared", "leader", "n")).alias("best")).select("node", "best.leader", "best.n")
    first = stored(dealt(own), "first")
    heads = first.select("leader", "i").distinct().withColumn("node", F.col("leader"))
    star = first.select("leader", "i", "node").unionByName(heads)
    links = compared(star.select("leader", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "node", F.col("node").alias("root")))
    roots = components(links)

    state = groups.join(roots, "node", "left").select("leader", "node", "n", F.coalesce("root", "node").alias("root"))
    several = state.groupBy("leader").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("leader")
    parted = dealt(state.join(several, "leader"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    meets = parted.select("leader", "node", "root", "i", other.alias("o")).select("leader", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("o") < F.col("i")).cast("int").alias("side"), "node", "root")
    more = compared(meets)
    if not more.isEmpty():
        links, roots = links.unionByName(more), components(more, roots)

    placed = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("node", "root", "component_id")
    out = rows.where("n_shingles > 0").join(named, "node").select("doc_id", "key", "n_shingles", "node", "root", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "key", "n_shingles", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone), links
