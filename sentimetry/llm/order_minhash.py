"""Operator 4: near-duplicate classes by order min-hash and banded alignment.

A text is its sequence of words (A-Z lower-cased, runs of letters, digits and
non-ASCII bytes), and of its shingles of ``shingle`` words (one shingle if it
has fewer words).  Shingles are labelled with their occurrence number.  Each of
``sketches`` hash functions samples the ``sample`` least labelled shingles and
retains them in text order; texts with an equal sample in one function fall in
one bucket, so reordered text doesn't meet as easily as edited text.

Texts of equal words are one node.  In a bucket a node meets its leader (the
least node) and the nodes next to it; large buckets are cut by the next
function's sample first, so no bucket is a pair list.  Candidates whose sizes
or sketch bits rule out the threshold go; the rest are verified by alignment of
their shingles within the band that the threshold leaves: the similarity is
m / (a + b - m) with m shingles matched in order.  Then, while links are found,
bucket members outside the component of the bucket's best linked node are
compared with that node: this joins star-shaped groups whose centre wasn't the
leader.  Last, all other pairs of a bucket whose nodes are still in different
components are compared, so no such pair is left untested.  Buckets of one
leader are one group, so a family that shares many buckets is compared a few
times only; a group is dealt into blocks, a task takes two blocks with their
texts, drops pairs by size and sketch bits, aligns the others, and gives out
only links that join components: no pair is a row.  Components come from hooking
and contraction; nothing is collected.

Defined results: null counts as empty, and texts without a word are copies of
each other; a null id is kept, and a class of null ids only has a null class
id; repeated rows are in one class; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import stored
from .textbytes import Block, blocks, mix

SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


@dataclass(frozen=True)
class NearDuplicates:
    """``large``: bucket size from which it is cut for the first links;
    ``neighbours``: how many nodes before it a node meets for them; ``block``:
    shingles of all texts in a block of the last comparison, about; ``bits_agree``: sketch bins (of 64)
    whose two bits must agree, over 5 deviations below what a pair at the
    threshold shows."""

    shingle: int = 5
    threshold: float = 0.8
    sketches: int = 16
    sample: int = 3
    large: int = 64
    neighbours: int = 4
    block: int = 400_000
    bits_agree: int = 38


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each shingle; ``word``: 32-bit word hashes, in order."""
    total = np.bincount(text, minlength=n_texts)
    w = word.astype(np.uint64)
    out = np.zeros(len(w), np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    same = np.arange(len(w))
    last = (np.cumsum(total) - 1)[text]
    for j in range(width):
        inside = same + j <= last
        out *= step
        out[inside] += w[same[inside] + j] + np.uint64(1)
    first = np.cumsum(total) - total
    full = (same + width - 1 <= last) | (same == first[text])
    return mix(out[full]), text[full]


def labelled(shingle: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Shingle hashes that also tell the occurrence number within the text."""
    key = mix(shingle ^ (text.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    number = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    out = shingle.copy()
    again = number > 0
    out[order[again]] = mix(shingle[order[again]] + number[again].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out


def order_samples(label: np.ndarray, text: np.ndarray, p: NearDuplicates) -> np.ndarray:
    """Signature of each text and function; every text has a labelled shingle, in text order."""
    n = int(text[-1]) + 1 if len(text) else 0
    first = np.searchsorted(text, np.arange(n))
    size = np.diff(np.append(first, len(text)))
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    signature = np.zeros((n, p.sketches), np.uint64)
    for f in range(p.sketches):
        h = mix(label ^ mix(np.array([f + 1], np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)))
        h[h == most] -= np.uint64(1)
        places = np.full((n, p.sample), len(text), np.int64)
        for r in range(p.sample):
            least = np.minimum.reduceat(h, first) if n else h[:0]
            at = np.flatnonzero(h == np.repeat(least, size))
            at = at[h[at] != most]  # one place for each text that has a shingle left
            places[text[at], r] = at
            h[at] = most
        ordered = np.sort(places, axis=1)
        padded = np.append(label, np.uint64(0))
        value = np.zeros(n, np.uint64)
        for r in range(p.sample):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + padded[ordered[:, r]])
        signature[:, f] = value
    return signature


BINS = 64


def sketch_bits(label: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Two bits of the least hash in each of ``BINS`` bins, in two 64-bit numbers
    a text; texts of Jaccard similarity J agree in about J + (1 - J) / 4 of them."""
    h = mix(label ^ np.uint64(0x589965CC75374CC3))
    least = np.full(n * BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    np.minimum.at(least, text * BINS + (h >> np.uint64(58)).astype(np.int64), h)
    bits = (mix(least) & np.uint64(3)).reshape(n, BINS)
    out = np.zeros((n, 2), np.uint64)
    for i in range(BINS):
        out[:, i // 32] |= bits[:, i] << np.uint64(i % 32 * 2)
    return out


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash, text) of each word."""
    block.lower()
    start, end, text = block.words(SEPARATOR)
    return (block.hashes(start, end) >> np.uint64(32)).astype(np.uint32), text


SKETCHES = "doc_id long, key long, node long, n int, low long, high long, samples array<long>"


def _sketch(p: NearDuplicates):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in blocks(batch.column("text")):
                word, text = words_of(block)
                n = len(block)
                place = np.arange(len(word)) - np.searchsorted(text, np.arange(n))[text]
                value = mix(word.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + place.astype(np.uint64))
                node = np.zeros(n, np.uint64)
                np.add.at(node, text, value)
                node = mix(node + np.bincount(text, minlength=n).astype(np.uint64))
                shingle, owner = shingles(word, text, n, p.shingle)
                have, owner = np.unique(owner, return_inverse=True)
                label = labelled(shingle, owner)
                signature = order_samples(label, owner, p)
                bits = np.zeros((n, 2), np.uint64)
                bits[have] = sketch_bits(label, owner, len(have))
                filled = np.zeros(n, np.int32)
                filled[have] = p.sketches
                rows = batch.slice(at, n)
                yield pa.record_batch([
                    rows.column("doc_id"), rows.column("key"), pa.array(node.view(np.int64)),
                    pa.array(np.bincount(have[owner], minlength=n).astype(np.int32)), pa.array(bits[:, 0].view(np.int64)), pa.array(bits[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(filled)]).astype(np.int32)), pa.array(signature.ravel().view(np.int64))),
                ], names=[x.split()[0] for x in SKETCHES.split(", ")])

    return sketch


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, block in blocks(batch.column("text")):
            word, text = words_of(block)
            parts = np.split(word, np.searchsorted(text, np.arange(1, len(block))))
            yield pa.record_batch([batch.slice(at, len(block)).column("node"), pa.array([x.tobytes() for x in parts], pa.binary())], names=["node", "words"])


def matched(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Greatest number of elements matched in order, within the band in which
    ``least`` can be reached; 0 if it can't.  Sparse alignment: the longest
    increasing chain of equal places (i, j) with |i - j| inside the band."""
    short = min(len(a), len(b))
    if short < least:
        return 0
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    done = head + tail
    if not len(a) or not len(b):
        return done if done >= least else 0
    before, behind = len(a) + done - least, len(b) + done - least  # unmatched that either may have
    where: dict[int, list[int]] = defaultdict(list)
    for j, x in enumerate(b.tolist()):
        where[x].append(j)
    chain: list[int] = []
    for i, x in enumerate(a.tolist()):
        places = where.get(x)
        if places:
            lo, hi = i - before, i + behind
            for j in reversed(places):
                if lo <= j <= hi:
                    k = bisect_left(chain, j)
                    if k == len(chain):
                        chain.append(j)
                    else:
                        chain[k] = j
    return done + len(chain) if done + len(chain) >= least else 0


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """m / (a + b - m) of two shingle sequences, or 0 below the threshold."""
    both = len(a) + len(b)
    least = int(np.ceil(threshold * both / (1 + threshold) - 1e-9))
    m = matched(a, b, least)
    return m / (both - m) if m else 0.0


def _verify(p: NearDuplicates):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(128)
        def of(words: bytes) -> tuple[np.ndarray, frozenset[int]]:
            w = np.frombuffer(words, np.uint32)
            shingle, text = shingles(w, np.zeros(len(w), np.int64), 1, p.shingle)
            return shingle, frozenset(labelled(shingle, text).tolist())

        def similar_to(x: bytes, y: bytes) -> float:
            (a, in_a), (b, in_b) = of(x), of(y)
            common = len(in_a & in_b)  # no more can match in order
            return similarity(a, b, p.threshold) if common >= p.threshold * (len(a) + len(b) - common) - 1e-6 else 0.0

        for batch in batches:
            similar = [similar_to(x.as_py(), y.as_py()) for x, y in zip(batch.column("left"), batch.column("right"))]
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(similar, pa.float64())], names=["a", "b", "similarity"])
            yield out.filter(pa.array([s > 0 for s in similar], pa.bool_()))

    return verify


def joined(words: list[bytes], size: np.ndarray, bits: np.ndarray, root: np.ndarray, side: np.ndarray, p: NearDuplicates) -> list[tuple[int, int, float]]:
    """Similar pairs that join components, of all pairs of different sides (one
    side only: of all pairs)."""
    of = np.unique(root, return_inverse=True)[1]
    across, links = side.min() != side.max(), []
    half = np.uint64(0x5555555555555555)

    @lru_cache(None)
    def text(i: int) -> tuple[np.ndarray, frozenset[int]]:
        w = np.frombuffer(words[i], np.uint32)
        shingle, at = shingles(w, np.zeros(len(w), np.int64), 1, p.shingle)
        return shingle, frozenset(labelled(shingle, at).tolist())

    for i in range(len(words) - 1):
        rest = np.arange(i + 1, len(words))
        rest = rest[(of[rest] != of[i]) & (np.minimum(size[rest], size[i]) >= np.maximum(size[rest], size[i]) * p.threshold)]
        if across:
            rest = rest[side[rest] != side[i]]
        apart = bits[rest] ^ bits[i]
        apart = np.bitwise_count((apart | (apart >> np.uint64(1))) & half).sum(axis=1, dtype=np.int64)
        for j in rest[apart <= BINS - p.bits_agree].tolist():
            if of[j] == of[i]:
                continue
            (a, in_a), (b, in_b) = text(i), text(j)
            common = len(in_a & in_b)  # no more can match in order
            if common >= p.threshold * (len(a) + len(b) - common) - 1e-6 and (alike := similarity(a, b, p.threshold)):
                links.append((i, j, alike))
                of[of == of[j]] = of[i]
        if not across and (of == of[0]).all():
            break
    return links


def _compare(p: NearDuplicates):
    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("leader", "i", "j", "side", "node", "root", "n", "low", "high", "words")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in groupby(rows(batches), key=lambda r: r[:3]):
            _, _, _, side, node, root, n, low, high, words = zip(*block)
            bits = np.array([low, high], np.int64).T.copy().view(np.uint64)
            links = joined(list(words), np.array(n), bits, np.array(root), np.array(side), p)
            if links:
                a, b, alike = zip(*links)
                ends = np.sort(np.array([[node[i] for i in a], [node[i] for i in b]], np.int64), axis=0)
                yield pa.record_batch([pa.array(ends[0]), pa.array(ends[1]), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])

    return compare


def _like(p: NearDuplicates) -> Column:
    """Whether sizes and sketch bits of ``x`` and ``y`` don't rule the threshold out."""
    fold = lambda c: F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")).bitwiseOR(F.shiftrightunsigned(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}")), 1)).bitwiseAND(F.lit(0x5555555555555555)))
    far = (fold("low") + fold("high")) > BINS - p.bits_agree
    small = F.least("x.n", "y.n") < F.greatest("x.n", "y.n") * p.threshold
    return (F.col("x.node") != F.col("y.node")) & ~small & ~far


def _possible(pairs: DataFrame, p: NearDuplicates) -> DataFrame:
    """Distinct (a, b), a < b, that sizes and sketch bits don't rule out."""
    kept = pairs.where(_like(p))
    return kept.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of ``docs`` (doc_id, text).  classes: doc_id, key (of the
    row's id and text), node, root (of its class) and class_id (least id of the
    class), for every row; links: (a, b, similarity) between different texts, by
    node, enough to join each class, not all of it."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = stored(docs.mapInArrow(_sketch(p), SKETCHES), "sketches")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("samples").alias("samples"))
    entry = nodes.select("node", "key", "n", "low", "high", "samples", F.posexplode("samples").alias("band", "sample"))
    entry = entry.withColumn("next", F.try_element_at("samples", (F.col("band") + 1) % p.sketches + 1)).drop("samples")
    full = entry.groupBy("band", "sample").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1")
    bucket = stored(entry.join(full, ["band", "sample"]), "buckets")

    one = F.struct("node", "n", "low", "high")
    cut = F.when(F.col("members") > p.large, F.col("next")).otherwise(F.lit(0))
    order = Window.partitionBy("band", "sample", cut).orderBy("node")
    before = F.collect_list(one).over(order.rowsBetween(-p.neighbours, -1))
    nearby = bucket.select(one.alias("x"), before.alias("before")).select("x", F.explode("before").alias("y"))
    heads = bucket.where(F.col("node") == F.col("leader")).select("band", "sample", one.alias("y"))
    led = bucket.select("band", "sample", one.alias("x")).join(heads, ["band", "sample"]).select("x", "y")
    pairs = _possible(nearby.unionByName(led), p)

    member = bucket.groupBy("node").agg(F.first("key").alias("key"))
    words = stored(docs.join(member, "key").dropDuplicates(["node"]).select("node", "text").mapInArrow(_sequences, "node long, words binary"), "words")

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (words.select(F.col("node").alias(k), F.col("words").alias(side)) for k, side in (("a", "left"), ("b", "right")))
        return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_verify(p), "a long, b long, similarity double"), "links")

    tried = stored(pairs, "candidates")
    links = verified(tried)
    roots = components(links)
    while True:
        degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        state = bucket.join(roots, "node", "left").join(degree, "node", "left").select("band", "sample", "node", "n", "low", "high", F.coalesce("root", "node").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
        hubs = state.groupBy("band", "sample").agg(F.max(F.struct("degree", "node", "n", "low", "high", "root")).alias("y")).where("y.degree > 0")
        apart = state.select("band", "sample", "root", one.alias("x")).join(hubs, ["band", "sample"]).where(F.col("root") != F.col("y.root"))
        fresh = stored(_possible(apart, p).join(tried, ["a", "b"], "left_anti"), "candidates")
        more = verified(fresh)
        if more.isEmpty():
            break
        tried, links, roots = tried.unionByName(fresh), links.unionByName(more), components(more, roots)

    state = bucket.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = state.groupBy("band", "sample").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("band", "sample")
    group = state.join(several, ["band", "sample"]).groupBy("leader", "node").agg(*[F.first(c).alias(c) for c in ("n", "low", "high", "root")])
    group = stored(group, "groups")
    many = group.groupBy("leader").agg(F.ceil(F.sum("n") / p.block).alias("blocks"))
    dealt = group.join(many, "leader").withColumn("i", F.pmod(F.xxhash64("node"), "blocks"))
    other = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = other.select("leader", "node", "n", "low", "high", "root", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), (F.col("o") < F.col("i")).cast("int").alias("side"))
    blocks_of = meets.join(words, "node").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side", "node")
    more = stored(blocks_of.mapInArrow(_compare(p), "a long, b long, similarity double"), "links")
    if not more.isEmpty():
        links, roots = links.unionByName(more), components(more, roots)

    root = rows.select("doc_id", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = nodes.select("node", "least_id").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least_id").alias("class_id"))
    out = root.join(classes, "root").select("doc_id", "key", "node", "root", "class_id")
    return out, links


def one_of_each(docs: DataFrame, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``docs`` with the row of least id (then least hash) of each class only;
    of equal rows one stays, and a null id comes last."""
    classes, _ = near_duplicates(docs, p)
    first = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("at")).select(F.col("at.key").alias("kept_key"))
    row = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("kept_key"))
    one = row.join(first, "kept_key").dropDuplicates(["kept_key"])
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
