"""Quality rules: counts over words and lines, and how a public vocabulary takes a text apart.

A tokeniser trained on ordinary prose needs few tokens for ordinary prose. Per text: characters per token, the share of
tokens that are bytes because no piece fits, and the entropy of the tokens, each with a band of accepted values per script.
The bands are fixed parameters, widened by the standard errors of a text's number of tokens, so every document is judged by itself, in one pass, alike at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.arrays import U, Words, blocks, mix
from tidegrid.llm.pieces import pieces
from tidegrid.llm.token_count import read_model
from tidegrid.llm.workers import map_batches, texts_of

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: Scripts by the first byte of a character in UTF-8; the script of a text is the one of most of its letters.
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "cjk", "hangul", "other")
_LEADS = {"latin": [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)], "greek": [0xCE, 0xCF],
          "cyrillic": [*range(0xD0, 0xD5)], "hebrew": [0xD6, 0xD7], "arabic": [*range(0xD8, 0xDC)],
          "indic": [0xE0, 0xE1], "cjk": [*range(0xE3, 0xEA)], "hangul": [*range(0xEA, 0xEE)]}
_SCRIPT = np.full(256, SCRIPTS.index("other"), np.uint8)
for _name, _bytes in _LEADS.items():
    _SCRIPT[_bytes] = SCRIPTS.index(_name)
_IS_LETTER = _SCRIPT != SCRIPTS.index("other")


@dataclass(frozen=True)
class Band:
    """Accepted values of a long text. The least entropy is a share of what SETTLED tokens, or all if fewer, could have."""

    chars_per_token: tuple[float, float]
    most_bytes: float
    least_entropy: float


#: Prose of a script that the vocabulary knows, and of one it mostly spells out.
KNOWN = Band((1.75, 8.0), 0.15, 0.66)
SPELT = Band((0.3, 8.0), 1.0, 0.4)
BANDS: Mapping[str, Band] = {"latin": KNOWN, "cyrillic": Band((1.2, 8.0), 0.15, 0.55)}
#: The fewer tokens, the further a clean text's means stray: limits are widened by so many standard errors. The characters of
#: a token of prose vary by SPREAD of their mean (0.65 to 0.74 in licences and the Python manual).
ERRORS, SPREAD = 2, 0.7
SETTLED = 512
#: Bits per token that no prose has: half-way between pieces as uneven as words are (10.5 for Zipf's law over 32,000) and even
#: ones (15.0). Fewer than some 6,700 tokens cannot have as many.
MOST_ENTROPY = 12.7
ROWS = 128

METRICS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, "
           "token_entropy double, script string")


def word_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per row of a block: words, their code points, symbols, words in repeated runs of five, and the script."""
    rows, words = len(offsets) - 1, Words(data, offsets)
    lead = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(lead)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    chars = np.bincount(words.row, points[words.end] - points[words.start], rows).astype(np.int64)
    h, at = words.runs(5)
    key = mix(h, words.row[at].astype(U))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    n = len(words.start)
    cover = np.bincount(at[twice], minlength=n + 5) - np.bincount(at[twice] + 5, minlength=n + 5)
    repeated = np.cumsum(cover)[:n] > 0
    row = np.repeat(np.arange(rows), np.diff(offsets))
    letter = _IS_LETTER[data]
    scripts = np.bincount(row[letter] * len(SCRIPTS) + _SCRIPT[data[letter]], minlength=rows * len(SCRIPTS))
    scripts = scripts.reshape(rows, len(SCRIPTS))
    script = np.where(scripts.any(1), scripts.argmax(1), SCRIPTS.index("other"))
    return {"n_words": words.count, "word_chars": chars, "n_symbols": np.diff(symbols[offsets]),
            "n_repeat_words": np.bincount(words.row[repeated], minlength=rows), "script": script,
            "n_chars": np.diff(points[offsets])}


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _entropy(ids: np.ndarray) -> float:
    if len(ids) < 2:
        return 0.0
    n = np.bincount(ids)
    n = n[n > 0]
    return float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids))


def judge(column: pa.Array, model: bytes, bands: Mapping[str, Band] = BANDS) -> dict[str, list | np.ndarray]:
    """All measures and the verdict for a column of texts."""
    encoder = pieces(model)
    out: dict[str, list] = {}
    for first, data, offsets in blocks(column):
        counts = word_counts(data, offsets)
        texts = [t or "" for t in column[first:first + len(offsets) - 1].to_pylist()]
        counts["n_dup_lines"] = np.array([duplicate_lines(t) for t in texts])
        n, spelt, entropy = [], [], []
        for begin in range(0, len(texts), ROWS):
            for ids in encoder.encode(texts[begin:begin + ROWS]):
                n.append(len(ids))
                spelt.append(int(encoder.is_byte[ids].sum()))
                entropy.append(_entropy(ids))
        n, spelt, entropy = np.array(n), np.array(spelt), np.array(entropy)
        some = np.maximum(n, 1)
        counts |= {"n_tokens": n, "chars_per_token": counts.pop("n_chars") / some, "byte_share": spelt / some,
                   "token_entropy": entropy}
        counts["base_failed"] = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        rule = [bands.get(SCRIPTS[s], SPELT) for s in counts["script"]]
        low, high, most, flat = np.array([(*b.chars_per_token, b.most_bytes, b.least_entropy) for b in rule]).T
        flat = flat * np.log2(np.clip(n, 1, SETTLED))
        error = ERRORS / np.sqrt(some)
        low, high, most = low * (1 - SPREAD * error), high * (1 + SPREAD * error), most + error * np.sqrt(most * (1 - most))
        inside = ((counts["chars_per_token"] >= low) & (counts["chars_per_token"] <= high) & (counts["byte_share"] <= most)
                  & (entropy >= flat - 1e-9) & (entropy <= MOST_ENTROPY))
        counts["kept"] = ~counts["base_failed"] & inside
        counts["script"] = np.array(SCRIPTS)[counts["script"]]
        for k, v in counts.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def quality_rules(docs: DataFrame, model: bytes, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """Every measure and the verdict ``kept`` for each row of ``docs`` (doc_id, text; other columns are not read).

    ``base_failed``: under ten words, or over a fifth of the words in repeated runs of five. ``kept``: not base_failed, and
    the measures of the vocabulary are inside the band of the text's script, which is wider for texts of few tokens.
    A null or empty text has no words and fails. A null doc_id is kept, repeated rows give equal rows, an empty table gives
    an empty one.
    """
    names = [f.split()[0] for f in METRICS.split(", ")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = judge(batch.column("text"), model, bands)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[k]) for k in names[1:])], names)
        pieces(model).forget()

    return map_batches(texts_of(docs), measure, METRICS)


def keep_good(docs: DataFrame, model: bytes, text: str = "text", bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is kept by ``quality_rules``.

    A null or empty text fails, so its row goes. Rows with a null doc_id and repeated rows are judged like any other; an empty
    table gives an empty one.
    """
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(judge(batch.column(at), model, bands)["kept"]))
        pieces(model).forget()

    return map_batches(docs, keep, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                         read_model(public_tokenizers.path("piece_bpe_32k.model")))
