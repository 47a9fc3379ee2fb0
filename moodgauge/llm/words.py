"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a longest run of bytes other than space and U+0009..U+000D. The
separators are ASCII, so the byte view gives the same words as the text.
Texts are handled in blocks of a few hundred KB: a block is one byte buffer
plus the offsets of its texts, and everything below is array arithmetic over
that buffer. Hashes are 64 bits wide; equal words give equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# an odd multiplier and its inverse modulo 2**64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_WINDOW_SEED = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers:
    """Powers of the multiplier and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_P, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_P_INV, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def spans_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of ``values[lo:hi]`` for every pair of bounds; it does not depend
    on where the span lies. Empty spans give the hash of nothing."""
    n = len(values)
    up, down = _POWERS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.multiply(values, up[:n], out=total[1:], dtype=np.uint64, casting="unsafe")
    np.cumsum(total, out=total)
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


@dataclass
class Block:
    """Words of a run of texts: ``first`` is the row of its first text."""

    first: int
    data: np.ndarray        # bytes of all texts
    offsets: np.ndarray     # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray      # byte bounds of the words
    ends: np.ndarray
    word_at: np.ndarray     # words of text i are word_at[i]:word_at[i + 1]

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.n_words)

    def count(self, flag: np.ndarray) -> np.ndarray:
        """Number of set bytes of ``flag`` in each text."""
        c = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]

    def word_hash(self, lower: bool = False) -> np.ndarray:
        data = _LOWER[self.data] if lower else self.data
        return spans_hash(data, self.starts, self.ends)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and text, of every window of ``size``
        words that lies in one text."""
        n = np.maximum(self.n_words - size + 1, 0)
        text = np.repeat(np.arange(self.n_texts), n)
        before = np.cumsum(n) - n
        first = np.arange(len(text)) - np.repeat(before, n) + np.repeat(self.word_at[:-1], n)
        return first, text


def string_array(column) -> pa.Array:
    """One Arrow array of texts, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def blocks(column, block_bytes: int = BLOCK_BYTES, separators: np.ndarray = _SEP) -> Iterator[Block]:
    """Cut a column of texts into blocks; a longer text is a block alone.
    ``separators`` flags the (ASCII) bytes that part words."""
    arr = string_array(column)
    if not len(arr):
        return
    _, off, raw = arr.buffers()
    off = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(arr):
        to = int(np.searchsorted(off, off[at] + block_bytes, "right")) - 1
        to = min(max(to, at + 1), len(arr))
        yield _block(at, raw[off[at]:off[to]], off[at:to + 1] - off[at], separators)
        at = to


def _block(first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Block:
    n = len(data)
    inner = np.zeros(n + 1, bool)       # a text begins or ends here
    inner[offsets] = True
    full = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = full[:-1]
    before &= ~inner[:n]
    after = np.zeros(n, bool)
    after[:-1] = full[1:]
    after &= ~inner[1:]
    starts = np.flatnonzero(full & ~before)
    ends = np.flatnonzero(full & ~after) + 1
    return Block(first, data, offsets, starts, ends, np.searchsorted(starts, offsets))


def window_hash(word_hash: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word of ``first`` on."""
    if not len(first):
        return np.zeros(0, np.uint64)
    if size <= 8:
        h = np.zeros(len(first), np.uint64)
        for j in range(size):
            c = pow(_WINDOW_SEED, 2 * j + 1, 1 << 64)
            h += word_hash[first + j] * np.uint64(c)
        return mix(h + np.uint64(size))
    return spans_hash(word_hash, first, first + size)
