"""Operator 8: quality rules by distribution divergence.

Each language gets two references from all its documents: the histogram of
character classes and the histogram of its common words (the ``common_words``
words in most documents, and a bin for the rest).  Documents weigh alike in a
reference, whatever their length, but those under ``least_chars`` or
``least_words`` weigh by their share of it, as they are noisy.  A document is compared with the references
of its language by Jensen-Shannon distance (root of the base-2 divergence, 0 to
1) and rejected above ``max_char`` or ``max_word``; texts under ``least_chars``
or ``least_words`` have too little to compare and pass.  Repetition is judged
before that by the base rule.

Words are counted in tasks and reduced by (language, word hash), so hot words
and languages are sums, not groups; a word in at least a hundredth of its
language's documents, by weight, may be common, which bounds what one language ranks.

Defined results: null text has no words; a null language is a language of its
own; an empty text fails the base rule; repeated rows are judged each; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored
from .textbytes import WHITE_SPACE, Block, blocks, mix

SYMBOLS = b"#*$%&|<>"
CLASSES = 7  # lower, upper, digit, blank, sentence marks, other ASCII, beyond ASCII
CLASS_OF = np.full(256, 5, np.uint8)
CLASS_OF[97:123], CLASS_OF[65:91], CLASS_OF[48:58] = 0, 1, 2
CLASS_OF[[32, *range(9, 14)]] = 3
CLASS_OF[[*b".,;:!?'\"()-"]] = 4
CLASS_OF[128:192] = 255  # the rest of a character
CLASS_OF[192:] = 6
UNIT = 1 << 30  # shares are whole numbers of this fraction, so sums don't depend on order
FLUSH_WORDS = 1_000_000


@dataclass(frozen=True)
class Rules:
    least_base_words: int = 10
    repeat_percent: int = 20
    common_words: int = 64
    max_char: float = 0.25
    max_word: float = 0.33
    least_chars: int = 400
    least_words: int = 150


def per_text(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n) if weights is not None else np.bincount(owner, minlength=n)


def char_histograms(block: Block) -> np.ndarray:
    """Characters of each class, by text."""
    kind = CLASS_OF[block.data]
    total = np.zeros((len(block), CLASSES), np.int64)
    full = block.end > block.start
    for c in range(CLASSES):
        seen = np.concatenate([[0], np.cumsum(kind == c)])
        total[full, c] = seen[block.end[full]] - seen[block.start[full]]
    return total


def grouped(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): ``order`` sorts by (owner, key), stable; ``first``: where groups begin in it."""
    both = mix(key ^ (owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))
    order = np.argsort(both, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = both[order][1:] != both[order][:-1]
    return order, np.flatnonzero(new)


def repeated_words(word: np.ndarray, text: np.ndarray, n: int, width: int = 5) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more."""
    starts = len(word) - width + 1
    if starts < 1:
        return np.zeros(n, np.int64)
    window = np.zeros(starts, np.uint64)
    for j in range(width):
        window = window * np.uint64(0x9E3779B97F4A7C15) + word[j : j + starts]
    at = np.flatnonzero(text[:starts] == text[width - 1 :])
    order, first = grouped(mix(window[at]), text[at])
    again = np.zeros(len(at), bool)
    again[order] = np.repeat(np.diff(np.append(first, len(at))) > 1, np.diff(np.append(first, len(at))))
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.add.at(change, at[again] + width, -1)
    return per_text(text[np.cumsum(change[:-1]) > 0], n)


def repeated_lines(block: Block) -> np.ndarray:
    """Lines of each text that have a word and equal an earlier line of it."""
    feed = np.flatnonzero(block.data == 10)  # ends of lines; a text's own end too
    start = np.concatenate([[0], feed[:-1] + 1])
    text = np.searchsorted(block.end, start)
    words = np.concatenate([[0], np.cumsum(~WHITE_SPACE[block.data])])
    full = words[feed] > words[start]
    start, end, text = start[full], feed[full], text[full]
    order, first = grouped(block.hashes(start, end), text)
    later = np.ones(len(order), bool)
    later[first] = False
    return per_text(text[order[later]], len(block))


# ---- references ------------------------------------------------------------

SHARES = "lang string, word long, docs long, share long"


def _shares(r: Rules):
    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with a word and the sum of its shares, by language; words
        below 0 and above -CLASSES - 2 stand for character classes and, last, all
        documents and their weight."""
        held: list[tuple] = []
        names: dict[str | None, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            lang, word, share = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, first = grouped(word.view(np.uint64), lang)
            times = np.diff(np.append(first, len(order)))
            own = order[first]
            label = pa.array(list(names), pa.string()).take(pa.array(lang[own]))
            return pa.record_batch([label, pa.array(word[own]), pa.array(times), pa.array(np.add.reduceat(share[order], first) if len(first) else share)], names=[x.split()[0] for x in SHARES.split(", ")])

        for batch in batches:
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
            for at, block in blocks(batch.column("text")):
                n = len(block)
                chars = char_histograms(block)
                block.lower()
                start, end, text = block.words(WHITE_SPACE)
                word = block.hashes(start, end).view(np.int64) | np.int64(1 << 40)
                word = np.where(word < 0, word ^ np.int64(-(1 << 63)), word)  # words are above 0
                n_words = per_text(text, n)
                order, first = grouped(word.view(np.uint64), text)
                own, times = order[first], np.diff(np.append(first, len(order)))
                lang = langs[at : at + n]
                held.append((lang[text[own]], word[own], (times * UNIT // np.maximum(n_words[text[own]], r.least_words)).astype(np.int64)))
                fit = np.flatnonzero(chars.sum(axis=1) > 0)
                for c in range(CLASSES):
                    held.append((lang[fit], np.full(len(fit), -1 - c), chars[fit, c] * UNIT // np.maximum(chars[fit].sum(axis=1), r.least_chars)))
                every = np.flatnonzero(n_words > 0)
                held.append((lang[every], np.full(len(every), -1 - CLASSES), n_words[every] * UNIT // np.maximum(n_words[every], r.least_words)))
                size += len(own)
                if size >= FLUSH_WORDS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return shares


def references(docs: DataFrame, r: Rules = Rules()) -> list[dict]:
    """Rows (lang, word, share): at most ``common_words`` words and the classes of
    each language; ``word`` below 0 is a class."""
    total = docs.mapInArrow(_shares(r), SHARES).groupBy("lang", "word").agg(F.sum("docs").alias("docs"), F.sum("share").alias("share"))
    total = stored(total.where((F.col("word") < 0) | (F.col("docs") > 1)), "shares")
    sizes = total.where(F.col("word") == -1 - CLASSES).select(F.col("lang").alias("of"), F.col("share").alias("weight"))
    known = total.join(sizes, F.col("lang").eqNullSafe(F.col("of"))).where((F.col("word") < 0) | (F.col("docs") * 100 >= F.col("weight") / UNIT))
    order = Window.partitionBy("lang", F.col("word") < 0).orderBy(F.col("docs").desc(), "word")
    top = known.withColumn("rank", F.row_number().over(order)).where((F.col("word") < 0) | (F.col("rank") <= r.common_words))
    return [x.asDict() for x in top.where(F.col("word") > -1 - CLASSES).select("lang", "word", (F.col("share") / F.col("weight")).alias("share")).collect()]


# ---- the verdict -----------------------------------------------------------


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of p from q; rows sum to 1."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _judge(rows: list[dict], r: Rules):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, bool)
        symbol[[*SYMBOLS]] = True
        known = {}
        for lang in {x["lang"] for x in rows}:
            own = [x for x in rows if x["lang"] == lang]
            words = sorted((x["word"], x["share"]) for x in own if x["word"] >= 0)
            chars = np.zeros(CLASSES)
            for x in own:
                if x["word"] < 0:
                    chars[-1 - x["word"]] = x["share"]
            share = np.array([x[1] for x in words])
            known[lang] = (np.array([x[0] for x in words], np.int64), np.append(share, max(0.0, 1 - share.sum())), chars / max(chars.sum(), 1e-12))
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, block in blocks(batch.column("text")):
                n = len(block)
                chars = char_histograms(block)
                seen = np.concatenate([[0], np.cumsum(symbol[block.data])])
                n_symbols = seen[block.end] - seen[block.start]
                start, end, text = block.words(WHITE_SPACE)
                n_words = per_text(text, n)
                dup = repeated_lines(block)
                repeat = repeated_words(block.hashes(start, end), text, n)
                block = Block([block.data[a:b].tobytes() for a, b in zip(block.start, block.end)])
                block.lower()
                word = block.hashes(start, end).view(np.int64) | np.int64(1 << 40)
                word = np.where(word < 0, word ^ np.int64(-(1 << 63)), word)
                bounds = np.searchsorted(text, np.arange(n + 1))
                far_char, far_word = np.zeros(n), np.zeros(n)
                for i in range(n):
                    reference = known.get(langs[at + i])
                    if reference is None:
                        continue
                    common, share, char_share = reference
                    if chars[i].sum() >= r.least_chars and char_share.sum() > 0:
                        far_char[i] = js_distance(chars[i] / chars[i].sum(), char_share)
                    if n_words[i] >= r.least_words and len(common):
                        own = word[bounds[i] : bounds[i + 1]]
                        place = np.minimum(np.searchsorted(common, own), len(common) - 1)
                        count = np.bincount(np.where(common[place] == own, place, len(common)), minlength=len(common) + 1)
                        far_word[i] = js_distance(count / len(own), share)
                failed = (n_words < r.least_base_words) | (100 * repeat > r.repeat_percent * n_words)
                kept = ~failed & (far_char <= r.max_char) & (far_word <= r.max_word)
                ids = batch.slice(at, n).column("doc_id")
                cells = [ids, *(pa.array(x.astype(np.int64)) for x in (n_words, chars.sum(axis=1) - chars[:, 3], n_symbols, dup, repeat)), pa.array(failed), pa.array(kept), pa.array(far_char), pa.array(far_word)]
                yield pa.record_batch(cells, names=[x.split()[0] for x in RESULT.split(", ")])

    return judge


def quality_rules(docs: DataFrame, r: Rules = Rules()) -> DataFrame:
    """Counts, base rule, distances and verdict for every row of ``docs`` (doc_id, text, lang)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return docs.mapInArrow(_judge(references(docs.select("text", "lang"), r), r), RESULT)
