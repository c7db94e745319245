"""Operator 2: language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised and held in one Bloom filter: an
n-gram of level q is entered q times, as (n-gram, 1) .. (n-gram, q), and a
reader probes levels upwards until the first miss.  Texts are scored by an
interpolated bigram with absolute discounting, every count coming from such probes.

Counting runs in Spark over all training texts: tasks reduce their own texts
to (n-gram hash, count), shuffle them as packed blocks by filter segment, and
each segment is summed and filled by one task.  A segment is as large as its
counted entries ask for (``bits_per_entry`` each), and there are more segments the
more training text there is, so the filter grows with the corpus and holds
every counted n-gram.  The mass that discounting frees after contexts of a level
is counted too: distinct pairs by context, joined to the contexts' counts.

A filter of up to ``broadcast_bytes``, which is measured, goes to every worker.
A larger one stays where it is: neighbouring segments form buckets of bounded size,
texts are dealt into chunks, the distinct n-grams of a chunk travel to their
buckets in one row each, and a task that holds a bucket probes all that is asked of
it as it comes.  Only levels come back to the chunk, which knows its n-grams in
order.  Both ways give the same levels.  The exact unigram base
score doesn't use the filter: the commonest words (at most ``head_words``) are
broadcast, all others are joined by hash.

Defined results: null or empty text has one token, the end; a null id counts
as training; repeated rows are scored each; an empty table gives no rows; without
training text every count is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored
from .textbytes import WHITE_SPACE, Block, blocks, mix, run_starts

END = np.uint64(0x5EAF00D5EAF00D51)
FLUSH_TOKENS = 1_500_000
SCORE_BYTES = 1 << 20  # of texts scored at once
CHUNK_BYTES = 1 << 23
BUCKET_BYTES = 1 << 23  # of the filter in a bucket of segments
ANSWER_ENTRIES = 1 << 20  # n-grams probed at once
PIECE = 1 << 16  # n-grams in a row of counts, or asked in a row


@dataclass(frozen=True)
class Model:
    """``broadcast_bytes``: largest filter that is sent to every worker;
    ``bits_per_entry``: bits an entry has; ``step``: ratio of count levels;
    ``discount``: what is taken off each pair count; ``head_words``: most words
    whose exact counts are broadcast for the base score; ``segment_text``: bytes
    of training text a segment, between ``least_segments`` and 65,536 of them."""

    broadcast_bytes: int = 1 << 27
    bits_per_entry: int = 12
    step: float = 1.25
    discount: float = 0.75
    head_words: int = 1 << 20
    segment_text: int = 1 << 21
    least_segments: int = 256

    def segments(self, text_bytes: int) -> int:
        """Number of segments, a power of two."""
        return 1 << (max(self.least_segments, min(text_bytes // self.segment_text, 1 << 16)) - 1).bit_length()


def level_floors(step: float) -> np.ndarray:
    """Least count of each level: 1, 2, 3, ... then growing by ``step``."""
    floors = [1]
    while floors[-1] < 1 << 50:
        floors.append(max(floors[-1] + 1, int(np.ceil(floors[-1] * step))))
    return np.array(floors, np.int64)


def level_values(step: float) -> np.ndarray:
    """The count a level stands for, by level; 0 for level 0."""
    floors = level_floors(step)
    return np.concatenate([[0.0], (floors[:-1] + floors[1:] - 1) / 2])


def levels_of(count: np.ndarray, step: float) -> np.ndarray:
    return np.searchsorted(level_floors(step)[:-1], count, side="right").astype(np.int64)


def segment_of(entry: np.ndarray, segments: int) -> np.ndarray:
    """By the leading bits, so sorted entries are sorted by segment."""
    return (entry >> np.uint64(1)) >> np.uint64(64 - segments.bit_length())


def bit_places(entry: np.ndarray, level: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, list[np.ndarray]]:
    """64-bit word of (entry, level) in a segment of ``size`` words, and the four
    bits in it: an entry's bits share a word, so a probe reads memory once."""
    h = mix(entry + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
    return (h >> np.uint64(32)) * size >> np.uint64(32), [h >> np.uint64(6 * i) & np.uint64(63) for i in range(4)]


def fill_segment(entry: np.ndarray, count: np.ndarray, model: Model) -> bytes:
    """Bits of one segment with all its n-grams, in little-endian words of 64."""
    level = levels_of(count, model.step)
    size = -(-int(level.sum()) * model.bits_per_entry // 64)
    bits = np.zeros(size * 64, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        entry, level = entry[level >= j], level[level >= j]
        word, places = bit_places(entry, j, np.uint64(size))
        for place in places:
            bits[word * np.uint64(64) + place] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """Segments one after the other in ``bits``, of ``size`` 64-bit words each: all of them,
    or those from ``at`` on of ``segments``."""

    def __init__(self, bits: bytes | bytearray, size: np.ndarray, model: Model, segments: int | None = None, at: int = 0):
        self.words, self.size = np.frombuffer(bits, np.uint64), size.astype(np.uint64)
        self.first, self.top = np.cumsum(self.size) - self.size, len(level_floors(model.step)) - 1
        self.segments, self.at = segments or len(size), np.uint64(at)

    def levels(self, entry: np.ndarray) -> np.ndarray:
        """Level of each entry: probe 1, 2, ... until a bit is missing, to the top level
        at most, however full the filter is."""
        level = np.zeros(len(entry), np.int64)
        segment = segment_of(entry, self.segments) - self.at
        at = np.flatnonzero(self.size[segment] > 0)
        entry, first, size = entry[at], self.first[segment[at]], self.size[segment[at]]
        for j in range(1, self.top + 1):
            if not len(at):
                break
            place, bits = bit_places(entry, j, size)
            mask = np.uint64(1) << bits[0]
            for bit in bits[1:]:
                mask |= np.uint64(1) << bit
            there = self.words[first + place] & mask == mask
            at, entry, first, size = at[there], entry[there], first[there], size[there]
            level[at] = j
        return level


class Answers:
    """Levels that were probed elsewhere: ``entry``, sorted, and ``level`` of all n-grams that are looked up."""

    def __init__(self, entry: np.ndarray, level: np.ndarray):
        self.entry, self.level = entry, level.astype(np.int64)

    def levels(self, entry: np.ndarray) -> np.ndarray:
        return self.level[np.searchsorted(self.entry, entry)]


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each token in order, the end token after each text's words."""
    block.lower()
    start, end, text = block.words(WHITE_SPACE)
    n = np.bincount(text, minlength=len(block)) + 1
    last = np.cumsum(n) - 1
    token = np.empty(int(n.sum()), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[is_end] = END
    token[~is_end] = block.hashes(start, end)
    return token, np.repeat(np.arange(len(block)), n)


def context_of(token: np.ndarray, text: np.ndarray, value: np.ndarray, at_start) -> np.ndarray:
    """The value of the token before each; a text's first token follows the end."""
    before = np.empty_like(value)
    before[1:] = value[:-1]
    before[run_starts(text)] = at_start
    return before


def pair_hash(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + token)


def pairs_of(token: np.ndarray, text: np.ndarray) -> np.ndarray:
    return pair_hash(context_of(token, text, token, END), token)


def _summed(parts: list[np.ndarray], counts: list[np.ndarray], more: list[np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with their sums and, of ``more``, a value that equal keys share."""
    keys = np.concatenate(parts or [np.zeros(0, np.uint64)])
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], np.concatenate(counts or [np.zeros(0, np.int64)])[order]
    first = run_starts(keys)
    out = keys[first], np.add.reduceat(weight, first) if len(first) else weight
    return out if more is None else (*out, np.concatenate(more or [np.zeros(0, np.uint64)])[order[first]])


COUNTED = "segment int, words binary, word_counts binary, contexts binary, runs binary, tokens binary, pair_counts binary"
_CELLS = [x.split()[0] for x in COUNTED.split(", ")[1:]]


def _count(segments: int):
    """Counts of a task's texts, by segment: words, and pairs as each context with
    the tokens after it, so that a context is sent once and a pair's hash not at all."""
    cut = np.arange(1, segments, dtype=np.uint64) << np.uint64(65 - segments.bit_length())

    def flush(words: list[np.ndarray], contexts: list[np.ndarray], pairs: list[np.ndarray]) -> pa.RecordBatch:
        token, context = np.concatenate(words), np.concatenate(contexts)
        w, wc = np.unique(token, return_counts=True)  # sorted by hash, so by segment too
        p, at, pc = np.unique(np.concatenate(pairs), return_index=True, return_counts=True)
        words.clear(), contexts.clear(), pairs.clear()
        segment, c, t = segment_of(p, segments), context[at], token[at]
        order = np.argsort(segment << np.uint64(48) | c >> np.uint64(16))
        segment, c, t, pc = segment[order], c[order], t[order], pc[order]
        run = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (segment[1:] != segment[:-1])]))
        numbers = np.arange(1, segments, dtype=np.uint64)
        bounds = lambda x, at: np.concatenate([[0], np.searchsorted(x, at), [len(x)]])
        at_w, at_p, at_c = bounds(w, cut), bounds(segment, numbers), bounds(segment[run], numbers)
        used = np.flatnonzero((at_w[1:] > at_w[:-1]) | (at_p[1:] > at_p[:-1]))
        cells = lambda x, at: pa.array([x[at[i] : at[i + 1]].tobytes() for i in used], pa.binary())
        return pa.record_batch([
            pa.array(used.astype(np.int32)), cells(w, at_w), cells(wc.astype(np.int64), at_w), cells(c[run], at_c),
            cells(np.diff(np.append(run, len(c))).astype(np.uint32), at_c), cells(t, at_p), cells(pc.astype(np.uint32), at_p),
        ], names=["segment", *_CELLS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        contexts: list[np.ndarray] = []
        pairs: list[np.ndarray] = []
        for batch in batches:
            for _, block in blocks(batch.column("text")):
                token, text = tokens_of(block)
                words.append(token)
                contexts.append(context_of(token, text, token, END))
                pairs.append(pair_hash(contexts[-1], token))
                if sum(map(len, words)) >= FLUSH_TOKENS:
                    yield flush(words, contexts, pairs)
        if words:
            yield flush(words, contexts, pairs)

    return count


FILLED = "segment int, bits binary, word array<long>, n array<long>, level array<int>, context array<long>, follow array<long>"


def _fill(model: Model):
    """Sum and fill the segments of a task, which come sorted, one after the other.  A
    segment gives its bits once and its words, and the distinct pairs by context,
    in rows of bounded size."""

    def filled(segment: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        column = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), kind)
        words, n = _summed([column(0, np.uint64)], [column(1, np.int64)])
        contexts = np.repeat(column(2, np.uint64), column(3, np.uint32))
        hashes = pair_hash(contexts, column(4, np.uint64))
        pairs, times, contexts = _summed([hashes], [column(5, np.uint32).astype(np.int64)], [contexts])
        context, follow = np.unique(contexts, return_counts=True)
        bits: bytes | None = fill_segment(np.concatenate([words, pairs]), np.concatenate([n, times]), model)
        level = levels_of(n, model.step).astype(np.int32)
        for i in range(0, max(len(words), len(context)), PIECE):
            lists = [words.view(np.int64), n, level, context.view(np.int64), follow.astype(np.int64)]
            yield pa.record_batch([pa.array([segment], pa.int32()), pa.array([bits], pa.binary()), *(pa.array([x[i : i + PIECE]], pa.list_(pa.from_numpy_dtype(x.dtype))) for x in lists)], names=[x.split()[0] for x in FILLED.split(", ")])
            bits = None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for segment, *cells in zip(*(batch.column(c).to_pylist() for c in ("segment", *_CELLS))):
                if segment != now and rows:
                    yield from filled(now, rows)
                    rows = []
                now = segment
                rows.append(cells)
        if rows:
            yield from filled(now, rows)

    return fill


class Scorer:
    """What scoring needs: ``source`` of levels, smoothing masses and corpus totals."""

    def __init__(self, source: Filter | Answers, model: Model, train_tokens: int, distinct: int, mass: np.ndarray):
        self.source, self.model, self.mass = source, model, mass
        self.value = level_values(model.step)
        self.total = train_tokens + distinct + 1

    def counts(self, token: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of the token, level of its context, count of the pair), from probes."""
        seen, back = np.unique(token, return_inverse=True)
        level = self.source.levels(seen)[back]
        context = context_of(token, text, level, self.source.levels(np.array([END]))[0])
        possible = np.flatnonzero((level > 0) & (context > 0))  # a pair can't be commoner than its words
        pair, pair_back = np.unique(pairs_of(token, text)[possible], return_inverse=True)
        pair_level = np.zeros(len(token), np.int64)
        pair_level[possible] = self.source.levels(pair)[pair_back]
        return self.value[level], context, self.value[np.minimum(pair_level, np.minimum(level, context))]

    def log10(self, token: np.ndarray, text: np.ndarray) -> np.ndarray:
        count, context, pair = self.counts(token, text)
        single = (count + 1) / self.total
        n = self.value[context]
        known = n > 0
        p = np.where(known, np.maximum(pair - self.model.discount, 0) / np.where(known, n, 1) + self.mass[context] * single, single)
        return np.log10(np.minimum(p, 1.0))


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, head_known long, head_log double, score double, word array<long>, n array<long>"


def _scored(own: pa.RecordBatch, token: np.ndarray, text: np.ndarray, scorer: Scorer, data: dict) -> pa.RecordBatch:
    """A block's texts scored; words outside the broadcast head are left to the join."""
    head, head_log = np.frombuffer(data["head"], np.uint64), np.frombuffer(data["head_log"], np.float64)
    n = own.num_rows
    place = np.minimum(np.searchsorted(head, token), max(len(head) - 1, 0))
    common = head[place] == token if len(head) else np.zeros(len(token), bool)
    rest_key, rest_text = token[~common], text[~common]
    order = np.lexsort((rest_key, rest_text))
    rest_key, rest_text = rest_key[order], rest_text[order]
    new = np.flatnonzero(np.concatenate([[True], (rest_key[1:] != rest_key[:-1]) | (rest_text[1:] != rest_text[:-1])])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(order)))
    offsets = pa.array(np.searchsorted(rest_text[new], np.arange(n + 1)).astype(np.int32))
    return pa.record_batch([
        own.column("row"), own.column("doc_id"), own.column("held_out"),
        pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text[common], minlength=n)),
        pa.array(np.bincount(text[common], head_log[place[common]], n) if len(head) else np.zeros(n)),
        pa.array(np.bincount(text, scorer.log10(token, text), n)),
        pa.ListArray.from_arrays(offsets, pa.array(rest_key[new].view(np.int64))),
        pa.ListArray.from_arrays(offsets, pa.array(times)),
    ], names=[x.split()[0] for x in SCORED.split(", ")])


def _score(shared, model: Model, mass: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        scorer = Scorer(Filter(data["bits"], data["sizes"], model), model, data["tokens"], data["types"], mass)
        for batch in batches:
            for first, block in blocks(batch.column("text"), SCORE_BYTES):
                yield _scored(batch.slice(first, len(block)), *tokens_of(block), scorer, data)

    return score


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of their chunk, of ``CHUNK_BYTES`` or one longer text."""
    chunk, total = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
        numbers = np.empty(len(size), np.int64)
        for i, n in enumerate(size.tolist()):
            if total and total + n > CHUNK_BYTES:
                chunk, total = chunk + 1, 0
            numbers[i], total = chunk, total + n + 1
        yield pa.record_batch([pa.array(numbers), *batch.columns], names=["chunk", *batch.schema.names])


def _tokens(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, tokens and their texts) by block."""
    return [(first, *tokens_of(block)) for first, block in blocks(texts, SCORE_BYTES)]


def _entries(tokens: list[tuple[int, np.ndarray, np.ndarray]]) -> np.ndarray:
    """The distinct n-grams looked up for texts, sorted."""
    entry = np.sort(np.concatenate([np.array([END]), *(x for _, token, text in tokens for x in (token, pairs_of(token, text)))]))
    return entry[run_starts(entry)]  # sorted: np.unique hashes first, which takes ten times as long


def _packed(entry: np.ndarray) -> bytes:
    """Sorted n-grams byte by byte: their leading bytes repeat, which compresses."""
    return entry.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


ASKED = "bucket int, chunk long, piece long, at long, data binary"
ANSWERED = "chunk long, piece long, at long, level binary"


def _ask(buckets: int):
    """The distinct n-grams of a chunk's texts, packed by bucket; ``at``: how many lie before.
    A chunk may come in several pieces, each named by its first row."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            first = run_starts(chunks)
            for a, b in zip(first, np.append(first[1:], len(chunks))):
                entry = _entries(_tokens(batch.column("text").slice(a, b - a)))
                bucket = segment_of(entry, buckets)
                new = run_starts(bucket)
                at = np.concatenate([np.arange(i, j, PIECE) for i, j in zip(new, np.append(new[1:], len(entry)))])
                packed = [_packed(entry[i:j]) for i, j in zip(at, np.append(at[1:], len(entry)))]
                same = [pa.array(np.full(len(at), x)) for x in (chunks[a], batch.column("row")[a].as_py())]
                yield pa.record_batch([pa.array(bucket[at].astype(np.int32)), *same, pa.array(at), pa.array(packed, pa.binary())], names=[x.split()[0] for x in ASKED.split(", ")])

    return ask


def _answer(segments: int, buckets: int, model: Model):
    """Levels of the n-grams asked of a bucket, which follow its segments' bits."""
    each, kind = segments // buckets, np.min_scalar_type(len(level_floors(model.step)))

    def answered(asked: list[tuple], source: Filter) -> pa.RecordBatch:
        entry = [_unpacked(x) for *_, x in asked]
        level = source.levels(np.concatenate(entry)).astype(kind)
        parts = np.split(level, np.cumsum([len(x) for x in entry[:-1]]))
        keys = [pa.array(x, pa.int64()) for x in list(zip(*asked))[:3]]
        return pa.record_batch([*keys, pa.array([x.tobytes() for x in parts], pa.binary())], names=[x.split()[0] for x in ANSWERED.split(", ")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits, asked, total = None, {}, [], 0
        source: Filter | None = None
        for batch in batches:
            for bucket, chunk, piece, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                if asked and (bucket != now or total >= ANSWER_ENTRIES):
                    yield answered(asked, source)
                    asked, total = [], 0
                if bucket != now:
                    now, bits, source = bucket, {}, None
                if chunk is None:
                    bits[at] = data
                    continue
                if source is None:
                    own = [bits.get(x, b"") for x in range(bucket * each, (bucket + 1) * each)]
                    source, bits = Filter(b"".join(own), np.array([len(x) // 8 for x in own]), model, segments, bucket * each), {}
                asked.append((chunk, piece, at, data))
                total += len(data) // 8
        if asked:
            yield answered(asked, source)

    return answer


def _score_chunk(shared, model: Model, mass: np.ndarray):
    kind = np.min_scalar_type(len(level_floors(model.step)))

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, out = shared.value, []
        texts = texts.sort_by("row").combine_chunks()
        rows, pieces = texts.column("row").to_numpy(), answers.column("piece").to_numpy()
        first = np.unique(pieces)  # a piece holds the rows from its first to the next one's
        cut = np.searchsorted(rows, first)
        for piece, a, b in zip(first, cut, np.append(cut[1:], len(rows))):
            own = texts.slice(a, b - a).combine_chunks().to_batches()[0]
            tokens = _tokens(own.column("text"))
            entry = _entries(tokens)
            level = np.empty(len(entry), kind)
            of_piece = answers.filter(pa.array(pieces == piece))
            for at, part in zip(of_piece.column("at").to_pylist(), of_piece.column("level").to_pylist()):
                part = np.frombuffer(part, kind)
                level[at : at + len(part)] = part
            scorer = Scorer(Answers(entry, level), model, data["tokens"], data["types"], mass)
            ends = [*(x[0] for x in tokens[1:]), own.num_rows]
            out += [_scored(own.slice(at, end - at), token, text, scorer, data) for (at, token, text), end in zip(tokens, ends)]
        return pa.Table.from_batches(out)

    return score


def _by_segments(docs: DataFrame, filled: DataFrame, segments: int, size: int, shared, model: Model, mass: np.ndarray) -> DataFrame:
    """Scores with a filter too large to broadcast: a task holds one bucket, through
    which pass the n-grams asked of it, or one chunk with its answers."""
    buckets = min(segments, 1 << (-(-size // BUCKET_BYTES)).bit_length())
    chunks = stored(docs.mapInArrow(_chunk, "chunk long, doc_id long, text string, held_out boolean, row long"), "lm-chunks")
    asked = chunks.select("chunk", "row", "text").mapInArrow(_ask(buckets), ASKED)
    none = F.lit(None).cast("long")
    bits = filled.where("bits is not null").select(F.floor(F.col("segment") / (segments // buckets)).cast("int").alias("bucket"), none.alias("chunk"), none.alias("piece"), F.col("segment").cast("long").alias("at"), F.col("bits").alias("data"))
    dealt = bits.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    answers = dealt.mapInArrow(_answer(segments, buckets, model), ANSWERED)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score_chunk(shared, model, mass), SCORED)


def _collected(filled: DataFrame, segments: int, size: int) -> dict:
    """The whole filter, of ``size`` bytes, and its segments' sizes in words."""
    bits, sizes, at = bytearray(size), np.zeros(segments, np.int64), 0
    table = filled.where("bits is not null").select("segment", "bits").orderBy("segment").toArrow()
    for segment, part in zip(table.column("segment").to_pylist(), table.column("bits")):
        part = part.as_buffer()
        bits[at : at + part.size], sizes[segment] = memoryview(part), part.size // 8
        at += part.size
    return {"bits": bits, "sizes": sizes}


def lm_scores(docs: DataFrame, training, model: Model = Model()) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text); ``training``: boolean column
    that picks the rows to learn from.  See the module for defined results."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(~training, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out")).select("text")
    segments = model.segments(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    counted = train.mapInArrow(_count(segments), COUNTED)
    filled = stored(counted.repartition("segment").sortWithinPartitions("segment").mapInArrow(_fill(model), FILLED), "lm-filter")

    words = filled.select(F.explode(F.arrays_zip("word", "n", "level")).alias("x")).select(F.col("x.word").alias("word"), F.col("x.n").alias("n"), F.col("x.level").alias("level"))
    band = F.floor(F.log2("n") * 8).cast("int").alias("band")  # a few hundred bands, whatever the corpus
    bands = words.groupBy(band).agg(F.count("*").alias("types"), F.sum("n").alias("tokens")).collect()
    tokens, types, least, room = sum(r.tokens for r in bands), sum(r.types for r in bands), 1 << 30, model.head_words
    for r in sorted(bands, key=lambda r: -r.band):
        room -= r.types
        if room < 0:
            break
        least = r.band
    head = words.where(band >= least).toArrow()  # at most head_words rows
    key = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(key)
    shared = {"tokens": tokens, "types": types, "head": key[order].tobytes(), "head_log": np.log10(head.column("n").to_numpy()[order] + 1.0).tobytes()}
    del head

    # Every token but a text's last is followed by one, so a context's count is also how often it is one.
    follow = filled.select(F.explode(F.arrays_zip("context", "follow")).alias("x")).groupBy(F.col("x.context").alias("word")).agg(F.sum("x.follow").alias("follow"))
    mass = np.ones(len(level_values(model.step)))
    for r in words.join(follow, "word").groupBy("level").agg(F.sum("follow").alias("follow"), F.sum("n").alias("n")).collect():
        mass[r.level] = min(1.0, model.discount * r.follow / r.n)

    docs = docs.withColumn("row", F.monotonically_increasing_id())
    size = filled.agg(F.sum(F.length("bits"))).first()[0] or 0
    sent_whole = size <= model.broadcast_bytes
    if sent_whole:  # each segment collected once
        shared |= _collected(filled, segments, size)
    sent = spark.sparkContext.broadcast(shared)
    del shared
    scored = docs.mapInArrow(_score(sent, model, mass), SCORED) if sent_whole else _by_segments(docs, filled, segments, size, sent, model, mass)
    scored = stored(scored, "lm-scored")
    sent.destroy()

    rest = scored.select("row", F.explode(F.arrays_zip("word", "n")).alias("x")).select("row", F.col("x.word").alias("word"), F.col("x.n").alias("times"))
    rare = words.where(band < least).select("word", "n")
    extra = rest.join(rare, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_log"))
    return scored.drop("word", "n").join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        "score",
    )
