"""Quality rules: shape of the text, then a log-likelihood ratio of hashed n-grams against a trusted target.

1. Every text gets plain counts (words, symbols, repeated lines and word windows); some shapes fail at once.
2. Texts of a strict shape are the *trusted target*; all texts are the *raw corpus*. Both are bags of word 1-grams and
   2-grams hashed to a fixed number of buckets, counted over all documents: two multinomials.
3. A text's score is the mean over its n-grams of log p(target) - log p(raw), so that it does not depend on the length.
   A text is kept if its score reaches the threshold; the verdict is a function of text and counts, without sampling.

Counts leave a task as one vector, are added up in two steps and come back as one table of ``BUCKETS`` ratios, whose
size is fixed: it is broadcast at any corpus size.

Null and empty texts have no words: all counts are 0 and the base rules fail. Repeated rows and ids are judged row by
row; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FACTOR, NOT_BLANK, joined, mix, sequence_hashes, slices, span_hashes, summed_vectors, texts_of, word_spans

BUCKETS = 1 << 18
BLOCK = 1 << 14
SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)])


@dataclass(frozen=True)
class Params:
    """``trusted_*``: shape of the trusted target. ``threshold``: least mean log ratio of a kept text."""

    least_words: int = 50
    most_repeated: float = 0.5
    trusted_symbols_per_word: float = 0.02
    trusted_capitals: float = 0.2
    smoothing: float = 1.0
    threshold: float = -0.15


@dataclass
class Shape:
    """Counts of the texts of one slice, and the hashed n-grams with the text that each belongs to."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    capitals: np.ndarray
    grams: np.ndarray
    gram_text: np.ndarray


def per_text(where: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(where, minlength=n)[:n].astype(np.int64)


def shape_of(texts: list[bytes]) -> Shape:
    n = len(texts)
    buffer, text_starts = joined(texts)
    starts, ends = word_spans(buffer, NOT_BLANK)
    text = np.searchsorted(text_starts, starts, side="right") - 1
    n_words = per_text(text, n)

    running = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(NOT_BLANK[buffer] & ((buffer & 0xC0) != 0x80), out=running[1:])
    word_chars = running[text_starts[1:]] - running[text_starts[:-1]]
    np.cumsum(SYMBOLS[buffer], out=running[1:])
    n_symbols = running[text_starts[1:]] - running[text_starts[:-1]]
    np.cumsum((buffer >= 0x41) & (buffer <= 0x5A), out=running[1:])
    capitals = running[text_starts[1:]] - running[text_starts[:-1]]

    breaks = np.flatnonzero(buffer == 0x0A)
    line_starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    wordly = np.searchsorted(starts, breaks) > np.searchsorted(starts, line_starts)
    line_starts, breaks = line_starts[wordly], breaks[wordly]
    line_text = np.searchsorted(text_starts, line_starts, side="right") - 1
    lines = mix(span_hashes(buffer, line_starts, breaks) + line_text.astype(np.uint64) * np.uint64(FACTOR))
    first = ~pd.Series(lines).duplicated().to_numpy()
    n_dup_lines = per_text(line_text[~first], n)

    words = span_hashes(buffer, starts, ends)
    triples = sequence_hashes(words, 3)
    within = text[: len(triples)] == text[2:] if len(triples) else np.zeros(0, bool)
    own = mix(triples[within] + text[: len(triples)][within].astype(np.uint64) * np.uint64(FACTOR))
    codes, _ = pd.factorize(own)
    often = np.bincount(codes, minlength=1)[codes] > 1 if len(codes) else np.zeros(0, bool)
    at = np.flatnonzero(within)[often]
    repeated = np.zeros(len(words), bool)
    for shift in range(3):
        repeated[at + shift] = True
    n_repeat_words = per_text(text[repeated], n)

    pairs = sequence_hashes(words, 2)
    inside = text[:-1] == text[1:] if len(words) > 1 else np.zeros(0, bool)
    grams = np.concatenate([mix(words), pairs[inside]]) & np.uint64(BUCKETS - 1)
    gram_text = np.concatenate([text, text[:-1][inside]]) if len(words) else text
    return Shape(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, capitals, grams.astype(np.int64), gram_text)


def base_failed(shape: Shape, params: Params) -> np.ndarray:
    return (shape.n_words < params.least_words) | (100 * shape.n_repeat_words > 100 * params.most_repeated * shape.n_words)


def trusted(shape: Shape, params: Params) -> np.ndarray:
    return (
        ~base_failed(shape, params)
        & (shape.n_symbols <= params.trusted_symbols_per_word * shape.n_words)
        & (shape.capitals <= params.trusted_capitals * shape.word_chars)
    )


def corpus_counts(documents: DataFrame, params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket of (target, raw corpus), over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            texts = texts_of(batch)
            for low, high in slices(texts):
                shape = shape_of(texts[low:high])
                raw += np.bincount(shape.grams, minlength=BUCKETS)
                target += np.bincount(shape.grams[trusted(shape, params)[shape.gram_text]], minlength=BUCKETS)
        both = np.concatenate([target, raw]).reshape(-1, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(both)), pa.int32()), pa.array([x.tobytes() for x in both], pa.binary())], ["block", "values"]
        )

    parts = documents.select("text").mapInArrow(run, "block int, values binary")
    out = np.zeros(2 * BUCKETS)
    for row in summed_vectors(parts).collect():  # 2 * BUCKETS / BLOCK rows of a fixed size
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["values"], np.float64)
    return out[:BUCKETS], out[BUCKETS:]


def log_ratios(target: np.ndarray, raw: np.ndarray, smoothing: float) -> np.ndarray:
    """log p(target) - log p(raw) per bucket. Without any trusted text the ratios are 0 and every text scores 0."""
    if not target.sum():
        return np.zeros(len(target))
    t = (target + smoothing) / (target.sum() + smoothing * len(target))
    r = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(t) - np.log(r)


def judge(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_ratio."""
    ratios = documents.sparkSession.sparkContext.broadcast(
        log_ratios(*corpus_counts(documents, params), params.smoothing)
    )
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
        " base_failed boolean, kept boolean, log_ratio double"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), texts_of(batch)
            for low, high in slices(texts):
                shape = shape_of(texts[low:high])
                total = np.bincount(shape.gram_text, ratios.value[shape.grams], minlength=high - low)
                score = total / np.maximum(1, np.bincount(shape.gram_text, minlength=high - low))
                failed = base_failed(shape, params)
                columns = [ids.slice(low, high - low), shape.n_words, shape.word_chars, shape.n_symbols, shape.n_dup_lines,
                           shape.n_repeat_words, failed, ~failed & (score >= params.threshold), score]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio"],
                )

    return documents.select("doc_id", "text").mapInArrow(run, schema)
