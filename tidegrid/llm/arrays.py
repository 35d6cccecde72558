"""Texts of Arrow batches as numpy arrays: bytes, words and the hashes of runs of them.

A hash here is 64 bits, made of multiply-and-shift steps over values drawn once from a fixed seed, so every task and every
retry agrees. Where a wrong match would change a result over the whole corpus, two hashes of different seeds are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on together; a longer single text is a block of its own.
BLOCK = 1 << 20
_M1, _M2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and where each row begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    if column.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


#: Bytes of text whose arrays are held and sorted together.
HELD = 8 << 20


def held(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = HELD) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about ``limit`` bytes of text; a longer single text is one of its own."""
    for batch in batches:
        offsets, row = text_bytes(batch.column(text))[1], 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
            yield batch.slice(row, end - row)
            row = end


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows taken together until they reach ``limit`` bytes: first row, bytes, offsets."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def mix(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the pair (a, b), in this order."""
    x = a * (_M1 if lane == 0 else _M2)
    x += b
    x ^= x >> U(29)
    x *= _M2 if lane == 0 else _M1
    x ^= x >> U(32)
    return x


def byte_values(lane: int = 0) -> np.ndarray:
    return np.random.default_rng(1 + lane).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as they have been asked for."""

    def __init__(self, lane: int):
        base = int(byte_values(7 + lane)[0]) | 7  # 7 modulo 8: its powers repeat late
        self.base, self.inverse = U(base & (2**64 - 1)), U(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK)
            up, down = np.full(size, self.base), np.full(size, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


_POWERS: dict[int, _Powers] = {}
_VALUES = {lane: byte_values(lane) for lane in range(2)}


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of each span of bytes [start, end)."""
    if len(start) == 0:
        return np.zeros(0, U)
    powers = _POWERS.setdefault(lane, _Powers(lane))
    up, down = powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUES[lane][data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start], (end - start).astype(U), lane)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a block: their spans, the row of each, and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        rows = len(offsets) - 1
        word = ~_SPACE[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        first[inner] = word[inner]  # a word ends with its text
        last = word.copy()
        last[:-1] &= ~word[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = word[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.begin = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.begin)
        self.row = np.repeat(np.arange(rows), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, lane)

    def runs(self, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each k consecutive words of one row, and the first word of each."""
        at = np.arange(len(self.start))
        at = at[self.begin[1:][self.row] - at >= k]
        return run_hashes(self.hashes(lane), k, lane)[at], at


def run_hashes(h: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """A hash of the k values from each place on, by doubling; places too near the end have some value."""
    out, done, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power if out is None else mix(out, _ahead(power, done), lane)
            done += size
        size *= 2
        if size > k:
            return out
        power = mix(power, _ahead(power, size // 2), lane)


def _ahead(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    if by < len(h):
        out[:len(h) - by] = h[by:]
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each place but the last width - 1, the smallest of the ``width`` values from it on."""
    n, size = len(h) - width + 1, 1
    if n <= 0:
        return h[:0]
    low = h
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return np.minimum(low[:n], low[width - size:][:n])
