"""Operator 9: word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links.  A trie node stands for the
text read since the last piece boundary; where the next byte has no edge, its
failure link leads to the node that greedy longest-match would be at after
giving out the node's pieces, and the number of those pieces is precomputed
with the link.  So a word's count takes one pass over its bytes, never reads a
byte twice and builds no piece.

Words are runs without white space, each with a blank before it, as byte-level
vocabularies hold them; pieces are byte strings.  A byte that no piece holds is
one piece by itself.  Counts of frequent words are kept by each task.

Defined results: null or empty text has no words and no tokens; repeated rows
are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEPT_WORDS = 200_000  # words whose counts a task remembers; others are counted again


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a rank file: base64 and rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """``edge``: {node << 8 | byte: node}; ``link`` and ``popped``: failure link
    of a node and the pieces given out along it."""

    def __init__(self, pieces: Iterable[bytes]):
        edge: dict[int, int] = {}
        parent, byte, is_piece = [0], [0], [False]
        alone = [bytes([b]) for b in range(256)]
        for piece in [*alone, *pieces]:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in edge:
                    edge[key] = len(parent)
                    parent.append(node), byte.append(b), is_piece.append(False)
                node = edge[key]
            if node:
                is_piece[node] = True
        children: list[list[int]] = [[] for _ in parent]
        for node in range(1, len(parent)):
            children[parent[node]].append(node)
        link, popped = [0] * len(parent), [0] * len(parent)
        queue = deque(children[0])
        while queue:  # by depth: links of shorter nodes are known
            node = queue.popleft()
            queue.extend(children[node])
            if is_piece[node]:
                popped[node] = 1  # the whole node is a piece; back to the root
                continue
            at, n = link[parent[node]], popped[parent[node]]
            while at << 8 | byte[node] not in edge:  # ends: the root has every byte
                n += popped[at]
                at = link[at]
            link[node], popped[node] = edge[at << 8 | byte[node]], n
        self.edge, self.link, self.popped = edge, link, popped

    def count(self, word: bytes) -> int:
        edge, link, popped = self.edge, self.link, self.popped
        node = n = 0
        for b in word:
            to = edge.get(node << 8 | b)
            while to is None:
                n += popped[node]
                node = link[node]
                to = edge.get(node << 8 | b)
            node = to
        while node:
            n += popped[node]
            node = link[node]
        return n


def _count(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LongestMatch(shared.value)
        known: dict[bytes, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                parts = (text or b"").split()  # the six blanks of ASCII
                total = 0
                for word in parts:
                    n = known.get(word)
                    if n is None:
                        n = automaton.count(b" " + word)
                        if len(known) < KEPT_WORDS:
                            known[word] = n
                    total += n
                words.append(len(parts))
                tokens.append(total)
            yield pa.record_batch([batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary: its size is given
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_count(shared), "doc_id long, n_words long, n_tokens long")


def lengths(words: list[bytes], pieces: Iterable[bytes]) -> np.ndarray:
    """Token counts of single words."""
    automaton = LongestMatch(pieces)
    return np.array([automaton.count(w) for w in words])
