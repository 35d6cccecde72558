"""Byte-level BPE by a sentencepiece model that is written from the ranks themselves, and back to bytes.

Each byte has a printable character; a token of the ranks becomes the piece of its bytes' characters, scored by its negative
rank, under an identity normalisation. The library then merges the pair of the lowest rank first, as the ranks mean it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.workers import map_batches, texts_of

#: Distinct pre-tokens remembered by a worker, and the longest that is.
KEPT, KEPT_CHARS = 1 << 19, 64
_UNKNOWN = 2
_BPE = 2


def byte_characters() -> list[str]:
    """A printable character for each byte: itself if it is visible, else one from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protocol buffer message."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece of index r is the token of rank r, with an unknown piece after all."""
    by_rank = {r: t for t, r in ranks.items()}
    size, shown = len(by_rank), byte_characters()
    if sorted(by_rank) != list(range(size)) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must be gapless from 0 and hold every byte")
    out = b"".join(_field(1, _field(1, "".join(shown[b] for b in by_rank[r]).encode()) + _field(2, float(-r)))
                   for r in range(size))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN))
    trainer = _field(3, _BPE) + _field(4, size + 1) + _field(40, size) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return out + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encoder and decoder of a model made by ``serialise``; pre-tokens are the matches of ``pattern``."""

    def __init__(self, model: bytes, pattern: str):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.match = regex.compile(pattern).findall
        shown = byte_characters()
        self.shown = dict(enumerate(shown))  # of a byte read as a code point
        back = {c: b for b, c in enumerate(shown)}
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size() - 1)]
        self.tokens = [bytes(back[c] for c in p) for p in pieces]
        # a pre-token that is a token is that token, whether or not merges lead to it
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def _learn(self, pre_tokens: set[str]) -> dict[str, bytes]:
        """The ids of the pre-tokens not known yet; those of short ones are remembered."""
        if len(self.known) > KEPT:
            self.known = {}
        found, merged = {}, []
        for p in pre_tokens - self.known.keys():
            if (own := self.whole.get(p.encode())) is not None:
                found[p] = own
            else:
                merged.append(p)
        mapped = [p.encode().decode("latin-1").translate(self.shown) for p in merged]
        for p, ids in zip(merged, self.library.encode(mapped, num_threads=1), strict=True):
            found[p] = struct.pack(f"<{len(ids)}I", *ids)
        self.known |= {p: x for p, x in found.items() if len(p) <= KEPT_CHARS}
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.match(t or "") for t in texts]
        found = self._learn(set().union(*split)) if split else {}
        out, known = [], self.known
        for s in split:
            try:
                out.append(b"".join(map(known.__getitem__, s)))
            except KeyError:  # long pre-tokens are only in found
                out.append(b"".join(known[p] if p in known else found[p] for p in s))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def byte_bpe(model: bytes, pattern: str) -> ByteBPE:
    """The encoder of a model, made once by each worker."""
    return ByteBPE(model, pattern)


#: Rows whose texts are split at once.
ROWS = 256


def encode_documents(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` (binary) for each row of ``docs``.

    Reads doc_id and text. A null or empty text has no ids. What the pattern does not match is not encoded. A null doc_id is
    kept, repeated rows give equal rows, an empty table gives an empty one.
    """
    return _coded(docs, model, pattern, lambda ids, text: (ids, text), ["ids", "decoded"], [pa.binary(), pa.binary()],
                  "doc_id long, ids binary, decoded binary")


def digest_documents(docs: DataFrame, model: bytes, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_documents``, made where the ids are."""
    return _coded(docs, model, pattern,
                  lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()),
                  ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()],
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coded(docs, model, pattern, row, names, kinds, schema) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(model, pattern)
        for batch in batches:
            for begin in range(0, len(batch), ROWS):
                part = batch.slice(begin, ROWS)
                ids = coder.encode(part.column("text").to_pylist())
                columns = zip(*(row(x, coder.decode(x)) for x in ids), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", *names])

    return map_batches(texts_of(docs), code, schema)


def multi_model() -> bytes:
    return serialise(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), multi_model(), public_tokenizers.PATTERN)
