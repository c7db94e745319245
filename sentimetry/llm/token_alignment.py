"""Operator 12: alignment of two tokenizers' tokens, each distinct text once.

Documents are shuffled by their full text, so a text that has many copies is
tokenised and aligned once, and its links count once for each copy.  Both
tokenizers cut the same bytes; where tokens of both end at one byte a group
ends, and two tokens whose byte ranges overlap are linked.  Links are what lies
between neighbouring token ends of either side: walking the merged ends gives
all of them in order.

A text is cut before each space that follows a byte which is no white space
under any reading: both tokenizers always end a token there, so pieces align by
themselves, long texts need memory for their pieces only, and each worker keeps
the alignment of the first ``kept`` pieces.  New pieces of a batch are tokenised
as one text: the byte-level vocabulary is read by a second, faster library where
all characters are of settled classes (tests hold both libraries together).

Then counts of id pairs are summed over the corpus.  Pairs beyond the ``head``
most frequent are looked up by a join, the head by a table sent to the tasks,
whose size is that parameter; per text both parts are added, and measures go to
the documents by the text's SHA-256.

Defined results: texts that are null, empty, not UTF-8, or not given back by
both tokenizers byte by byte have no tokens: zeros and an empty digest; a null
id is kept; repeated rows count as copies; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

#: Python's white space holds every other reading's but U+180E, which was white space before Unicode 6.3.
CUT = re.compile("(?<=[^\\s\u180e])(?= )")
BLANKS = re.compile("[\\s\u180e] ")
#: Words of the byte-level vocabulary: its pre-tokenizer's pattern.  Fixed value.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes no Unicode version changed; texts of others go to the slower library.
SETTLED = re.compile("[\0-\u024f]*")


@dataclass(frozen=True)
class Alignment:
    """``kept``: pieces whose alignment a worker keeps, of up to ``kept_chars``
    characters each; ``head``: most frequent id pairs sent to the tasks; ``flush``: pairs a
    task counts before it gives them out."""

    byte_bpe: str = "/opt/tokenizers/byte_bpe_50k.json"
    piece_bpe: str = "/opt/tokenizers/piece_bpe_32k.model"
    kept: int = 250_000
    kept_chars: int = 48
    head: int = 400_000
    flush: int = 1_000_000


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Pair:
    """Both tokenizers, the bytes of their ids, and the alignment of pieces: piece
    ``i`` has counts ``stats[i]``, its groups as ``groups[i]`` and its link codes
    at ``links[first[i] : first[i + 1]]``.  A piece is named without the space it begins with."""

    def __init__(self, p: Alignment):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(p.byte_bpe)
        self.a.encode_special_tokens = True
        to_byte = byte_of_char()
        special = set(self.a.get_added_tokens_decoder())
        self.bytes_a = {i: bytes(to_byte[c] for c in entry) for entry, i in self.a.get_vocab(with_added_tokens=True).items() if all(c in to_byte for c in entry)}
        self.fast_a = tiktoken.Encoding("ranks", pat_str=PRETOKEN, mergeable_ranks={x: i for i, x in self.bytes_a.items() if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=p.piece_bpe)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", x) else x.replace("▁", " ").encode() for x in pieces]
        self.blank = [self.b.piece_to_id("▁")]
        self.n_b = len(pieces)
        if any("▁" in x.lstrip("▁") for x in pieces):
            raise ValueError("a piece with a blank behind another character: texts can't be cut before blanks")
        n_a = max(self.bytes_a) + 1
        self.length_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(n_a)])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in range(max(n_a, self.n_b))], object).reshape(3, -1)
        self.index: dict[str, int] = {}
        self.stats, self.first, self.links, self.groups = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint64), []

    def ids_a(self, text: str) -> list[int]:
        return self.fast_a.encode_ordinary(text) if SETTLED.fullmatch(text) else self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        """``text`` begins with the space that the model adds, but not to nothing."""
        return self.b.encode(text[1:]) if len(text) > 1 else self.blank

    def _align(self, names: list[str]) -> bool:
        """Align pieces as one text and add them; False if that text isn't given back, or not cut at every piece."""
        text = " " + " ".join(names)
        a, b = self.ids_a(text), self.ids_b(text)
        if (raw := text.encode()) != b"".join([self.bytes_a.get(i, b"") for i in a]) or raw != b"".join([self.bytes_b[i] for i in b]):
            return False
        a, b = np.array(a), np.array(b)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        ends, both = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        cut = np.cumsum([len(x.encode()) + 1 for x in names])
        if not np.isin(cut, both, assume_unique=True).all():
            return False
        upto = lambda x: np.searchsorted(x, cut, side="right")
        tokens = [upto(x) for x in (end_a, end_b, both, ends)]
        stats = np.diff(np.stack(tokens, axis=1), axis=0, prepend=0)
        codes = a[np.searchsorted(end_a, ends)] * self.n_b + b[np.searchsorted(end_b, ends)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        sign_a, sign_b = np.isin(end_a, both, assume_unique=True).astype(int), np.isin(end_b, both, assume_unique=True) * 2
        out = np.empty(len(a) + len(b), object)  # group by group, A's ids before B's
        out[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = self.names[sign_a, a]
        out[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = self.names[sign_b, b]
        text_of, at = out.tolist(), np.concatenate([[0], tokens[0] + tokens[1]]).tolist()
        self.index.update(zip(names, range(len(self.groups), len(self.groups) + len(names))))
        self.groups += ["".join(text_of[x:y])[:-1] for x, y in zip(at, at[1:])]
        self.stats = np.concatenate([self.stats, stats])
        self.first = np.concatenate([self.first, self.first[-1] + tokens[3]])
        self.links = np.concatenate([self.links, codes.astype(np.uint64)])
        return True

    def learn(self, names: list[str]) -> None:
        """Align new pieces, together where they can stand in one text."""
        plain = [x for x in names if x and not x[-1].isspace() and "▁" not in x and "\u180e" not in x]
        if plain and not self._align(plain):
            half = len(plain) // 2
            for some in ([plain[:half], plain[half:]] if half else []):
                self.learn(some)
            if not half:
                self._refuse(plain[0])
        for x in set(names) - set(plain):
            if not self._align([x]):
                self._refuse(x)

    def _refuse(self, name: str) -> None:
        """A piece that isn't given back by both: no tokens."""
        self.index[name] = len(self.groups)
        self.groups.append("")
        self.stats = np.concatenate([self.stats, np.zeros((1, 4), np.int64)])
        self.first = np.append(self.first, self.first[-1])

    def forget(self, size: int, fresh: list[str]) -> None:
        """Keep the first ``size`` pieces; the others are among ``fresh``."""
        if size < len(self.groups):
            for x in fresh:
                if self.index[x] >= size:
                    del self.index[x]
            del self.groups[size:]
            self.stats, self.first = self.stats[:size], self.first[: size + 1]
            self.links = self.links[: self.first[-1]]

    def codes(self, piece: np.ndarray) -> np.ndarray:
        """Link codes of pieces, one after the other."""
        n = self.first[piece + 1] - self.first[piece]
        return self.links[np.arange(n.sum()) + np.repeat(self.first[piece] - np.cumsum(n) + n, n)]


_pairs: dict[Alignment, Pair] = {}


def _pair(p: Alignment) -> Pair:
    if p not in _pairs:
        _pairs.clear()
        _pairs[p] = Pair(p)
    return _pairs[p]


NONE = (0, 0, 0, 0, "")


def names_of(text: str) -> list[str]:
    """The pieces of space + ``text``, each without the space it begins with."""
    if text[0] != " " and not BLANKS.search(text):
        return text.split(" ")
    return [x[1:] for x in CUT.split(" " + text)]


def measures(pair: Pair, texts: list[str | None], p: Alignment) -> list[tuple[tuple, np.ndarray, np.ndarray]]:
    """((n_a, n_b, n_groups, n_links, digest), distinct link codes, their numbers) of each text."""
    none = (NONE, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    names = [names_of(x) if x else [] for x in texts]
    fresh = list({x for some in names for x in some if x not in pair.index})
    short = [x for x in fresh if len(x) <= p.kept_chars]
    if short:
        pair.learn(short)
    size = min(p.kept, len(pair.groups))
    if len(short) < len(fresh):
        pair.learn([x for x in fresh if len(x) > p.kept_chars])
    out = []
    for some in names:
        at = [pair.index[x] for x in some]
        piece, times = np.unique(np.array(at, np.int64), return_counts=True)
        stats = pair.stats[piece]
        if not some or not stats[:, 0].all():
            out.append(none)
            continue
        codes, place = np.unique(pair.codes(piece), return_inverse=True)
        number = np.bincount(place, weights=np.repeat(times, stats[:, 3]), minlength=len(codes)).astype(np.int64)
        groups = pair.groups
        digest = hashlib.sha256(";".join([groups[i] for i in at]).encode()).hexdigest()
        out.append(((*(stats * times[:, None]).sum(axis=0).tolist(), digest), codes, number))
    pair.forget(size, fresh)
    return out


ALIGNED = "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, numbers binary"


def _utf8(raw: bytes) -> str | None:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return None


def _align(p: Alignment):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(p)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                done = measures(pair, [_utf8(x) for x in some.column("text").to_pylist()], p)
                row = [list(x) for x in zip(*(d[0] for d in done))]
                yield pa.record_batch([some.column("text_key"), some.column("copies"), *(pa.array(x, pa.int64()) for x in row[:4]), pa.array(row[4], pa.string()), pa.array([d[1].tobytes() for d in done], pa.binary()), pa.array([d[2].astype(np.uint32).tobytes() for d in done], pa.binary())], names=[c.split()[0] for c in ALIGNED.split(", ")])

    return align


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, number of links) of a batch of aligned texts."""
    codes = batch.column("codes").to_pylist()
    row = np.repeat(np.arange(len(codes)), [len(c) // 8 for c in codes])
    return row, np.frombuffer(b"".join(codes), np.uint64), np.frombuffer(b"".join(batch.column("numbers").to_pylist()), np.uint32).astype(np.int64)


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code)
    code, n = code[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[start], np.add.reduceat(n, start) if len(code) else n


def _count(p: Alignment):
    def given(held) -> pa.RecordBatch:
        code, n = _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
        return pa.record_batch([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            row, code, number = _links(batch)
            held.append(_summed(code, number * np.asarray(batch.column("copies"), np.int64)[row]))
            size += len(held[-1][0])
            if size > p.flush:
                code, n = _summed(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
                held, size = [(code, n)], len(code)
                if size > p.flush:
                    yield given(held)
                    held, size = [], 0
        if held:
            yield given(held)

    return count


def _probe(head, rest: bool):
    """Sums over links in the head, or the links outside it."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = head.value
        for batch in batches:
            row, link, number = _links(batch)
            at = np.minimum(np.searchsorted(code, link), max(0, len(code) - 1))
            known = code[at] == link if len(code) else np.zeros(len(link), bool)
            if rest:
                out = np.flatnonzero(~known)
                yield pa.record_batch([batch.column("text_key").take(pa.array(row[out])), pa.array(link[out].view(np.int64)), pa.array(number[out])], names=["text_key", "code", "number"])
                continue
            row, at, number = row[known], at[known], number[known]
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row, number * best[at])
            np.add.at(sums[1], row, number * n[at])
            plain = [batch.column(c) for c in ("text_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.record_batch([*plain, *map(pa.array, sums)], names=["text_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return probe


def aligned_texts(docs: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """A row for each distinct text of ``docs`` (text): its SHA-256, copies, measures and links."""
    distinct = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    return distinct.select(F.unhex(F.sha2("text", 256)).alias("text_key"), "copies", F.col("text").cast("binary").alias("text")).mapInArrow(_align(p), ALIGNED)


def pair_counts(aligned: DataFrame, n_b: int, p: Alignment = Alignment()) -> DataFrame:
    """(code, n, best): links of each id pair in all documents, and whether no
    other pair of the B id has more; code = A id x ``n_b`` + B id."""
    counts = stored(aligned.select("copies", "codes", "numbers").mapInArrow(_count(p), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("most"))  # a row for each id of a vocabulary
    return counts.join(most, F.col("code") % n_b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def token_alignment(docs: DataFrame, p: Alignment = Alignment()) -> DataFrame:
    """Measures of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    aligned = stored(aligned_texts(docs, p), "aligned")
    pairs = stored(pair_counts(aligned, Pair(p).n_b, p), "pairs")
    head = pairs.orderBy(F.desc("n"), "code").limit(p.head).toArrow()  # p.head rows
    order = np.argsort(code := np.asarray(head.column("code"), np.int64).view(np.uint64))
    best = np.asarray(head.column("best").to_numpy(zero_copy_only=False), np.int64)
    shared = spark.sparkContext.broadcast((code[order], np.asarray(head.column("n"), np.int64)[order], best[order]))
    out = aligned.mapInArrow(_probe(shared, False), "text_key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if pairs.count() > p.head:
        rest = aligned.select("text_key", "codes", "numbers").mapInArrow(_probe(shared, True), "text_key binary, code long, number long")
        tail = rest.join(pairs, "code").groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("number")).otherwise(0)).alias("tail_best"), F.sum(F.col("n") * F.col("number")).alias("tail_sum"))
        out = out.join(tail, "text_key", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("tail_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("tail_sum", F.lit(0))})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("text_key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(out, "text_key", "left").select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
