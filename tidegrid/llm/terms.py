"""Words made of chosen bytes: their spans, their text and their checksums, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidegrid.llm.arrays import _LOWER

#: Bytes inside a word: letters and everything beyond ASCII, or digits as well. A-Z count as letters; words have a-z for them.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS_AND_DIGITS = LETTERS.copy()
LETTERS_AND_DIGITS[0x30:0x3A] = True
#: The generator of CRC-32 as zlib has it, bits reversed.
_GENERATOR = np.uint32(0xEDB88320)


def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), c >> np.uint32(1) ^ _GENERATOR, c >> np.uint32(1))
    return c


_STEP = _crc_steps()


class Terms:
    """The runs of bytes of a class in a block of texts, A-Z lower-cased: where each begins and ends, and its row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.data = _LOWER[data]
        word = inside[data]
        self.word = word
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        begins = offsets[:-1][offsets[:-1] < len(data)]
        first[begins] = word[begins]  # a word ends with its text
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = word[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.begin = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.begin)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def texts(self) -> pa.Array:
        """All words as strings."""
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        kept = np.ascontiguousarray(self.data[self.word])
        return pa.Array.from_buffers(pa.large_string(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])

    def checksums(self, runs: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """The unsigned CRC-32 of every run of ``runs`` consecutive words of one row, joined by one space, and its row.

        One byte of all runs is taken in at a time, so the steps follow the longest run and the work all bytes.
        """
        row = self.row
        at = np.arange(len(self.start))
        at = at[self.begin[1:][row] - at >= runs]
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(runs):
            if k:
                crc = _STEP[(crc ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ crc >> np.uint32(8)
            crc = _taken(crc, self.data, self.start[at + k], self.end[at + k])
        return ~crc, row[at]


def _taken(crc: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    order = np.argsort(-size, kind="stable")
    out, place = crc[order], start[order]
    live = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")  # words longer than 0, 1, 2, ... bytes
    for j, n in enumerate(live.tolist()):
        head = out[:n]
        out[:n] = _STEP[(head ^ data[place[:n] + j]) & np.uint32(0xFF)] ^ head >> np.uint32(8)
    back = np.empty_like(out)
    back[order] = out
    return back
