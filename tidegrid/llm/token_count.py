"""Tokens of whole texts, counted in batches of about equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.arrays import text_bytes
from tidegrid.llm.pieces import by_bytes, pieces
from tidegrid.llm.workers import map_batches, texts_of

#: Bytes of text whose parts are encoded together.
BATCH = 4 << 20


def read_model(path: str) -> bytes:
    """The bytes of a vocabulary file, for closures: workers then need no file."""
    with open(path, "rb") as f:
        return f.read()


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (doc_id, text; other columns are not read).

    ``n_tokens`` is the number of ids that the sentencepiece ``model`` gives for the whole text without special tokens.
    A null or empty text has no bytes and no tokens. A null doc_id is kept, repeated rows give equal rows, an empty table
    gives an empty one. Texts of any length are cut where merges cannot reach across (see ``pieces``).
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(model)
        for batch in batches:
            sizes = np.diff(text_bytes(batch.column("text"))[1])
            n = []
            for begin, end in by_bytes(sizes, BATCH, len(sizes)):
                n += encoder.lengths(batch.column("text")[begin:end].to_pylist())
            n = np.array(n, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])
        encoder.forget()

    return map_batches(texts_of(docs), count,
                       "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        read_model(public_tokenizers.path("piece_bpe_32k.model")))
