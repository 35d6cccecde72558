"""Encoding with a sentencepiece BPE vocabulary in parts that cannot influence each other.

A merge joins neighbours only into a piece of the vocabulary. Where no piece has a space after another character, a text may
be cut before every run of spaces; a part without spaces may be cut between two characters that no piece holds side by side.
The pieces of the parts are then the pieces of the whole text, equal parts are encoded once, and no call grows with a text.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import sentencepiece

#: Parts longer than this are cut again between characters that never meet inside a piece.
LONG = 1 << 12
#: Memory, about, of the parts that a worker remembers, and the longest of them.
KEPT_BYTES, KEPT_CHARS = 64 << 20, 64
#: Characters encoded by one call.
CALL = 1 << 20
#: A protocol buffer field appended to a model replaces the earlier one: here add_dummy_prefix = false.
_NO_PREFIX = b"\x1a\x02\x18\x00"
_SPACE = "▁"
_PART = re.compile(r" +[^ ]*")


class Pieces:
    """The ids of texts as the library gives them for ``model`` (the bytes of its file), without special tokens."""

    def __init__(self, model: bytes):
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [whole.id_to_piece(i) for i in range(whole.get_piece_size())]
        self.is_byte = np.array([whole.is_byte(i) for i in range(len(self.pieces))])
        normal = [p for i, p in enumerate(self.pieces)
                  if not (whole.is_byte(i) or whole.is_control(i) or whole.is_unknown(i))]
        #: Two characters that stand side by side in some piece.
        self.pairs = {p[j:j + 2] for p in normal for j in range(len(p) - 1)}
        if any(b == _SPACE and a != _SPACE for a, b in self.pairs) or whole.encode("a") != self.plain.encode(" a"):
            raise ValueError("this vocabulary has pieces across words, or does not put a space before a text")
        self.code = "H" if len(self.pieces) <= 1 << 16 else "I"
        self.forget()

    def forget(self) -> None:
        """Let go of all parts. A task that has read its input does, so that the stages of a job do not add up in a worker."""
        self.known: dict[str, bytes] = {}
        self.kept = 0

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut before every run of spaces."""
        if not text:
            return []
        text = text.replace(_SPACE, " ")  # the library takes this sign for a space
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p[1:] for p in _PART.findall(" " + text)]

    def cut(self, part: str) -> list[str]:
        """A long part, with its space, cut where no piece can reach across."""
        part, out, begin = " " + part, [], 0
        shown = part.replace(" ", _SPACE)
        for i in range(1, len(part)):
            if i - begin >= LONG and shown[i - 1:i + 1] not in self.pairs:
                out.append(part[begin:i])
                begin = i
        return [*out, part[begin:]]

    def learn(self, parts: set[str]) -> None:
        """Encode the parts not known yet, in calls of about equal size. ``encode`` drops the long ones again."""
        if self.kept > KEPT_BYTES:
            self.forget()
        new = list(parts - self.known.keys())
        cuts = {i: self.cut(p) for i, p in enumerate(new) if len(p) > LONG}
        flat = [" " + p for p in new]
        for i in sorted(cuts, reverse=True):
            flat[i:i + 1] = cuts[i]
        ids: list[list[int]] = []
        for begin, end in by_bytes(map(len, flat), CALL, len(flat)):
            ids += self.plain.encode(flat[begin:end], num_threads=1)
        for i in sorted(cuts):
            ids[i:i + len(cuts[i])] = [[x for part in ids[i:i + len(cuts[i])] for x in part]]
        code = self.code
        for p, own in zip(new, ids, strict=True):
            self.known[p] = array(code, own).tobytes()
            self.kept += 500 + 4 * len(p) + len(own) * 2  # with what the interpreter needs for two objects and their entry

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.parts(t or "") for t in texts]
        if split:
            self.learn(set().union(*split))
        get = self.known.__getitem__
        out = [np.frombuffer(b"".join(map(get, s)), self.code) for s in split]
        for p in {p for s in split for p in s if len(p) > KEPT_CHARS}:
            self.kept -= 500 + 4 * len(p) + len(self.known.pop(p)) // array(self.code).itemsize * 2
        return out

    def lengths(self, texts: list[str | None]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


@functools.lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    """The encoder of a model, made once by each worker."""
    return Pieces(model)


def by_bytes(sizes: Iterable[int], limit: int, count: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows, ``count`` in all, whose sizes add up to about ``limit``: first and end of each batch."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < count:
        yield begin, count
