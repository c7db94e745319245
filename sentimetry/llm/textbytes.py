"""Texts of an Arrow column as byte blocks, with vectorised substring hashes.

A block holds whole texts, one after the other with a line feed between them,
so work on many small texts is a few numpy calls and never a loop over bytes.
Hashes are polynomial sums over prefix totals, mixed to 64 bits: the hash of
any substring costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK_BYTES + BLOCK_BYTES // 4)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers, _inverses


class Block:
    """``data``: bytes of the texts; text ``i`` is ``data[start[i]:end[i]]``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(length + 1) - 1
        self.start = self.end - length
        self._prefix: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def lower(self) -> None:
        """Lower-case A-Z in place of the block's bytes."""
        up = (self.data >= 65) & (self.data <= 90)
        self.data = self.data + (up.view(np.uint8) << 5)

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            powers, _ = _power_table(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * powers[: len(self.data)], out=total[1:])
            self._prefix = total
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair."""
        total, inverses = self.prefix, _powers_of_inverse(len(self.data) + 1)
        out = total[end] - total[start]
        out *= inverses[start]
        out += (end - start).astype(np.uint64)
        return mix(out)

    def all_hashes(self, width: int) -> np.ndarray:
        """Hash of every substring of ``width`` bytes, by its start."""
        total, inverses = self.prefix, _powers_of_inverse(len(self.data) + 1)
        out = total[width:] - total[:-width]
        out *= inverses[: len(out)]
        out += np.uint64(width)
        return mix(out)

    def words(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes that aren't
        separators (``separator``: 256 booleans; a line feed must be one)."""
        gap = separator[self.data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[0::2], edge[1::2]
        return start, end, np.searchsorted(self.end, start, side="left")


def _powers_of_inverse(n: int) -> np.ndarray:
    return _power_table(n)[1]


WHITE_SPACE = np.zeros(256, bool)
WHITE_SPACE[[32, *range(9, 14)]] = True


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Block]]:
    """(number of the first text, block) over a string column; null is empty.
    A block holds up to ``size`` bytes, or one longer text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts: list[bytes] = []
    first = total = 0
    for i, value in enumerate(column.cast(pa.large_binary()) if len(column) else ()):
        text = value.as_py() or b""
        if texts and total + len(text) > size:
            yield first, Block(texts)
            texts, first, total = [], i, 0
        texts.append(text)
        total += len(text) + 1
    if texts:
        yield first, Block(texts)


def run_starts(key: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(key):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each window of ``width`` values, in log2(width) passes."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out
