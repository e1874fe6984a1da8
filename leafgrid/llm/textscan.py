"""Vectorised scanning of UTF-8 text columns.

A column batch is cut into blocks of a few megabytes.  In a block the texts lie
one after another in a byte buffer, each followed by one line feed, so neither
a word nor a line can run from one text into the next.  All functions work on
whole blocks with numpy; nothing loops over characters or words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAD = 8
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


@dataclass
class Block:
    """``data``: bytes, with ``PAD`` zero bytes behind them; text i and its line
    feed take ``data[first[i]:first[i + 1]]``."""

    data: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def body(self) -> np.ndarray:
        return self.data[:-PAD]

    def lowered(self) -> Block:
        """The block with A-Z, and nothing else, in lower case."""
        return Block(LOWER[self.data], self.first)


def blocks(column: pa.Array | pa.ChunkedArray, max_bytes: int = 4 << 20) -> Iterator[tuple[int, int, Block]]:
    """(first row, row behind the last, block) of runs of rows; null counts as an
    empty text.  A text over ``max_bytes`` makes a block of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(column):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        rows = column.slice(lo, hi - lo)
        joined = pc.binary_join_element_wise(rows, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        size = int(ends[hi - 1] - base)
        data = np.zeros(size + PAD, np.uint8)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data[:size] = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        yield lo, hi, Block(data, offsets - offsets[0])
        lo = hi


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([np.zeros(1, edge.dtype), edge])
    return edge[0::2], edge[1::2]


def words(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space, and
    for each text the bounds of its words in them (one more than texts)."""
    start, end = spans(~SPACE[block.body])
    return start, end, np.searchsorted(start, block.first)


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces between line feeds, and each text's bounds."""
    end = np.flatnonzero(block.body == 10)
    start = np.concatenate([np.zeros(min(1, len(end)), end.dtype), end[:-1] + 1])
    return start, end, np.searchsorted(start, block.first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def span_hash(block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, read eight bytes at a time."""
    eight = np.ndarray((len(block.data) - 7,), "<u8", buffer=block.data, strides=(1,))
    left = (end - start).astype(np.int64)
    out = mix(left.astype(U64) + U64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(left > 0)
    at = start[live]
    left = left[live]
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _MASK[np.minimum(left, 8)]))
        go = np.flatnonzero(left > 8)
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return out


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Order-aware hashes of all runs of ``width`` neighbouring hashes."""
    n = max(0, len(h) - width + 1)
    out = np.full(n, U64(0x2545F4914F6CDD1D * (width + 1) & (1 << 64) - 1), U64)
    for k in range(width):
        out = (out << U64(7) | out >> U64(57)) ^ h[k : k + n]
        out *= U64(0x9FB21C651E98DF25)
        out ^= out >> U64(29)
    return out


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each element the number of the text whose bounds hold it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's values (also right for texts without any)."""
    total = np.concatenate([np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(block: Block, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of characters in each byte span."""
    lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((block.body & 0xC0) != 0x80, dtype=np.int64)])
    return lead[end] - lead[start]
