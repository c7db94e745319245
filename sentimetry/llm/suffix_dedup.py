"""Operator 1: repeated substrings from merged shard Burrows-Wheeler transforms.

Finds every byte that a string of ``width`` bytes covers which starts anywhere
else too, in another text or the same one; overlaps count.

1. Anchors.  The least hash of the ``ANCHOR``-byte substrings of a window is
   the same wherever the window occurs.  Each text splits into runs of window
   starts with one anchor; the run's segment is the text its windows cover.
   Equal windows share their anchor, so an anchor of a single run that repeats
   no window inside itself needs no more work, and all else can be dealt out by
   anchor.  Runs are counted by (anchor, segment hash) before any text moves:
   an anchor with one segment text only, however many copies, is wholly
   repeated.
2. Transforms.  The distinct segments of the other anchors, each with its
   number of copies, are dealt out by anchor.  A task takes them in shards and
   builds each shard's multi-string BWT, over an alphabet of byte blocks:
   a segment gives one string for each offset modulo the block, so that a
   window is ``width / block`` characters and every byte starts a suffix.
3. Merging.  Shard transforms are merged pairwise by iterative interleave
   refinement: starting from "all of A, then all of B", each round carries the
   interleave through the BWT characters by a stable sort, which orders it by
   one more character.  Where neighbours part gives their common prefix; after
   ``width / block`` rounds the intervals that still hold together are the
   repeated windows.  No merged suffix is sorted anew.
4. Covered starts go back to all texts that hold the segment, as spans.

An anchor with more than ``HOT_RUNS`` runs is split by a second anchor, the
greatest hash of the window.  Text moves twice, by row; anchors move as hashes.

Defined results: null is the empty text; texts shorter than ``width`` have no
spans; repeated rows repeat each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textbytes import Block, blocks, mix, run_starts, sliding

ANCHOR = 32
HOT_RUNS = 20_000
SHARD_BYTES = 1 << 19
BATCH_BYTES = 1 << 21


# ---- anchors ---------------------------------------------------------------


def anchor_length(width: int) -> int:
    return max(1, min(ANCHOR, width // 2))


def valid_starts(block: Block, width: int, n: int) -> np.ndarray:
    """Whether a window starting there stays in its text."""
    change = np.zeros(len(block.data) + 2, np.int32)
    np.add.at(change, np.maximum(block.start, block.end - width + 1), 1)
    np.add.at(change, block.end + 1, -1)
    return np.cumsum(change)[:n] == 0


def runs_of(block: Block, width: int) -> tuple[np.ndarray, ...]:
    """(anchor, segment hash, text, start in text, number of starts, repeats inside) of each run."""
    k = anchor_length(width)
    if len(block.data) < width:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    h = block.all_hashes(k)
    low = sliding(h, width - k + 1)
    valid = valid_starts(block, width, len(low))
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    after = np.append(valid, False)
    stop = np.flatnonzero(np.append(new[1:], True) | ~after[1:])  # a run's last start, or no start
    last = stop[np.searchsorted(stop, first)]
    text = np.searchsorted(block.end, first)
    # Anchor places: least in some valid window.  One text with an anchor in two places may repeat itself.
    pad = np.zeros(width - k, np.uint64)
    place = np.flatnonzero(sliding(np.concatenate([pad, np.where(valid, low, 0), pad]), width - k + 1, np.maximum) == h)
    mark = lambda value, at: mix(value + at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    marks = np.sort(mark(h[place], np.searchsorted(block.end, place)))
    twice = np.unique(marks[1:][marks[1:] == marks[:-1]])
    own = mark(low[first], text)
    inside = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own if len(twice) else np.zeros(len(first), bool)
    return low[first], block.hashes(first, last + width), text, first - block.start[text], last - first + 1, inside


RUNS = "anchor long, segment long, key long, start int, n int, inside boolean"


def _runs(width: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            for at, block in blocks(batch.column("text")):
                anchor, segment, text, start, n, inside = runs_of(block, width)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(key[at + text]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(inside)], names=[x.split()[0] for x in RUNS.split(", ")])

    return runs


SEGMENTS = pa.schema([("bucket", pa.int64()), ("anchor", pa.int64()), ("segment", pa.int64()), ("skip", pa.int32()), ("copies", pa.int32()), ("data", pa.binary())])


def second_runs(data: bytes, width: int) -> Iterator[tuple[int, int, int]]:
    """(greatest hash, first start, number of starts) of the runs of a segment."""
    block = Block([data])
    high = sliding(block.all_hashes(anchor_length(width))[: len(data) - anchor_length(width) + 1], width - anchor_length(width) + 1, np.maximum)
    first = run_starts(high)
    yield from zip(high[first].view(np.int64).tolist(), first.tolist(), np.diff(np.append(first, len(high))).tolist())


def _cut(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                data = text.as_py().encode()
                for r in runs.as_py():
                    piece = data[r["start"] : r["start"] + r["n"] - 1 + width]
                    if not r["hot"]:
                        rows.append((r["anchor"], r["anchor"], r["segment"], 0, r["copies"], piece))
                        continue
                    for high, at, n in second_runs(piece, width):
                        rows.append((high ^ r["anchor"], r["anchor"], r["segment"], at, r["copies"], piece[at : at + n - 1 + width]))
                if len(rows) > 20_000:
                    yield pa.record_batch(list(map(list, zip(*rows))), schema=SEGMENTS)
                    rows = []
            if rows:
                yield pa.record_batch(list(map(list, zip(*rows))), schema=SEGMENTS)

    return cut


# ---- transforms ------------------------------------------------------------


class Transform:
    """A multi-string BWT: ``char``: character before each suffix, in suffix
    order (0: none), ``place``: where the suffix starts, ``strings``: how many;
    the first ``strings`` suffixes are the empty ones, in string order."""

    def __init__(self, char: np.ndarray, place: np.ndarray, strings: int):
        self.char, self.place, self.strings = char, place, strings


def characters(pieces: list[bytes], block_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the byte block at each place, 0 past the last; piece and offset of
    each place).  A piece of L bytes has L + 1 places, the last ``block_size`` of
    them the ends of its strings."""
    block = Block(pieces)
    length = block.end - block.start
    piece = np.repeat(np.arange(len(block)), length + 1)
    offset = np.arange(len(piece)) - block.start[piece]  # the line feed after a piece is its last place
    real = offset <= (length - block_size)[piece]
    at = np.flatnonzero(real)
    char = np.zeros(len(piece), np.uint64)
    char[at] = block.hashes(at, at + block_size) | np.uint64(1)
    return char, piece, offset


def transform(char: np.ndarray, offset: np.ndarray, base: int, block_size: int, depth: int) -> Transform:
    """BWT of one shard; ``char``: ranks from 1, 0 at string ends; suffixes are
    ordered by at least ``depth`` characters; ``base``: place of the first."""
    n = len(char)
    ends = np.flatnonzero(char == 0)
    rank = char.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    have = 1
    while have < depth:  # an end's rank is unique, so what lies past it doesn't matter
        step = have * block_size
        beyond = np.zeros(n, np.int64)
        beyond[: max(n - step, 0)] = rank[step:] + 1
        rank = np.unique(rank * (n + len(ends) + int(rank.max()) + 2) + beyond, return_inverse=True)[1]
        have *= 2
    order = np.argsort(rank, kind="stable")
    before = np.zeros(n, char.dtype)
    before[block_size:] = char[:-block_size]
    before[offset < block_size] = 0
    return Transform(before[order], order + base, len(ends))


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """Interleave refinement.  Returns the merged transform and, for each suffix,
    how many characters it has in common with the one before it, up to ``depth``."""
    n, strings = len(a.char) + len(b.char), a.strings + b.strings
    from_b = np.zeros(n, bool)
    from_b[len(a.char) :] = True
    interval = np.zeros(n, np.int64)  # suffixes that agree so far
    common = np.full(n, depth, np.int16)
    common[:1] = 0
    char = np.empty(n, a.char.dtype)
    for k in range(depth):
        char[~from_b], char[from_b] = a.char, b.char
        order = np.argsort(char, kind="stable")
        from_b, key, held = from_b[order], char[order], interval[order]
        from_b[: a.strings], from_b[a.strings : strings] = False, True  # the empty suffixes, in string order
        parts = np.ones(n, bool)
        parts[1:] = (key[1:] != key[:-1]) | (held[1:] != held[:-1])
        parts[: strings + 1] = True
        common[parts & (common == depth)] = k
        interval = np.cumsum(parts)
    place = np.empty(n, np.int64)
    place[~from_b], place[from_b] = a.place, b.place
    char[~from_b], char[from_b] = a.char, b.char
    return Transform(char, place, strings), common


def block_for(width: int) -> int:
    """Bytes in a character: the greatest divisor of the width up to 100."""
    return max(d for d in range(1, min(100, width) + 1) if width % d == 0 and (d < width or width == 1))


def repeated_starts(pieces: list[bytes], copies: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each piece, the starts of windows that also start anywhere else;
    ``copies``: how often the piece stands for itself."""
    block_size = block_for(width)
    depth = width // block_size
    char, piece, offset = characters(pieces, block_size)
    rank = np.unique(char, return_inverse=True)[1]
    rank = (rank + (1 if char.min(initial=0) else 0)).astype(np.int32)  # one alphabet for all shards, 0: no character
    size = np.bincount(piece, minlength=len(pieces))
    stop = np.cumsum(size)
    cuts = [0]
    for end in stop.tolist():  # shards of whole pieces
        if end - cuts[-1] >= SHARD_BYTES or end == stop[-1]:
            cuts.append(end)
    if len(cuts) == 2 and len(pieces) > 1:
        cuts.insert(1, int(stop[len(pieces) // 2 - 1]))
    shards = [transform(rank[x:y], offset[x:y], x, block_size, depth) for x, y in zip(cuts[:-1], cuts[1:])]
    if len(shards) == 1:  # one piece: merge with an empty shard
        shards.append(Transform(np.zeros(0, rank.dtype), np.zeros(0, np.int64), 0))
    while len(shards) > 1:
        merged = [merge(shards[i], shards[i + 1], depth) for i in range(0, len(shards) - 1, 2)]
        common = merged[-1][1]
        shards = [m[0] for m in merged] + shards[len(merged) * 2 :]
    place = shards[0].place
    first = np.flatnonzero(common < depth)
    total = np.add.reduceat(copies[piece[place]], first)
    again = place[np.repeat(total > 1, np.diff(np.append(first, len(place))))]
    again = again[offset[again] + width < size[piece[again]]]  # whole windows only
    again = np.sort(again)
    return np.split(offset[again], np.searchsorted(again, stop[:-1]))


RANGES = pa.schema([("anchor", pa.int64()), ("segment", pa.int64()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32()))])


def _repeats(width: int):
    def job(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_starts([r[5] for r in rows], np.array([r[4] for r in rows]), width)
        out: list[tuple] = []
        for row, starts in zip(rows, found):
            if len(starts):
                breaks = np.flatnonzero(np.diff(starts) > 1)
                out.append((row[1], row[2], starts[np.concatenate([[0], breaks + 1])] + row[3], starts[np.append(breaks, len(starts) - 1)] + row[3]))
        return pa.record_batch(list(map(list, zip(*out))) if out else [[]] * 4, schema=RANGES)

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        total = 0
        for batch in batches:  # sorted by bucket
            for row in zip(*(batch.column(c).to_pylist() for c in SEGMENTS.names)):
                if total >= BATCH_BYTES and row[0] != rows[-1][0]:
                    yield job(rows)
                    rows, total = [], 0
                rows.append(row)
                total += len(row[5])
        if rows:
            yield job(rows)

    return repeats


# ---- the operator ----------------------------------------------------------


def repeated_spans(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: array of (first, last) byte ranges,
    ends not included, that strings of ``width`` bytes found elsewhere cover."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    runs = stored(docs.where(F.octet_length("text") >= width).select("key", "text").mapInArrow(_runs(width), RUNS), "runs")
    anchors = (
        runs.groupBy("anchor")
        .agg(F.count("*").alias("runs"), F.min("segment").alias("least"), F.max("segment").alias("most"), F.max("inside").alias("inside"))
        .where((F.col("runs") > 1) | F.col("inside"))
        .select("anchor", ((F.col("least") == F.col("most")) & ~F.col("inside")).alias("whole"), (F.col("runs") > HOT_RUNS).alias("hot"))
    )
    found = stored(runs.drop("inside").join(anchors, "anchor"), "repeated-anchors")

    one = found.where(~F.col("whole")).groupBy("anchor", "segment").agg(F.min(F.struct("key", "start", "n")).alias("at"), F.count("*").alias("copies"), F.max("hot").alias("hot"))
    by_text = one.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("anchor", "segment", "at.start", "at.n", F.least("copies", F.lit(2)).cast("int").alias("copies"), "hot")).alias("runs"))
    pieces = docs.join(by_text, "key").select("text", "runs").mapInArrow(_cut(width), "bucket long, anchor long, segment long, skip int, copies int, data binary")
    ranges = stored(
        pieces.dropDuplicates(["bucket", "anchor", "segment", "skip"]).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_repeats(width), "anchor long, segment long, first array<int>, last array<int>"),
        "ranges",
    )

    span = F.struct(F.col("from"), F.col("to"))
    whole = found.where("whole").select("key", F.col("start").alias("from"), (F.col("start") + F.col("n") - 1 + width).alias("to"))
    parts = found.where(~F.col("whole")).join(ranges, ["anchor", "segment"]).select("key", "start", F.explode(F.arrays_zip("first", "last")).alias("x"))
    parts = parts.select("key", (F.col("start") + F.col("x.first")).alias("from"), (F.col("start") + F.col("x.last") + width).alias("to"))
    spans = whole.unionByName(parts).groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    return docs.join(spans, "key", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<from:int,to:int>>")).alias("spans"))


def joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = s["from"], s["to"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keep(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in spans:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            data, runs = text.as_py().encode(), joined(spans.as_py())
            rows.append((len(data), sum(b - a for a, b in runs), len(runs), hashlib.sha256(keep(data, runs)).hexdigest()))
        cells = zip(*rows) if rows else [[]] * 4
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digest(spans: DataFrame) -> DataFrame:
    """Per text: its bytes, those removed, the runs removed and the SHA-256 of what is kept."""
    return spans.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
