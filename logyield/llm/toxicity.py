"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words (lower-cased, letters and digits and everything beyond ASCII) give 1-grams, 2-grams and skip-grams (two words with
one between), hashed to ``BUCKETS`` coordinates; a text's features are the distinct coordinates. FTRL-proximal visits the
training texts one by one with a rate per coordinate; its L1 term leaves most weights at exactly 0, so the model is a
short list of (coordinate, weight) that is broadcast for scoring. Its length is at most ``BUCKETS``.

Training reads a bounded sample (``Params.most_rows`` labelled ids outside the held-out fold) in one task; scoring reads
every whole text. Empty and null texts have no features and get the score of the bias. Repeated rows are scored one by
one, extra columns are not read, an empty table gives an empty result. Without labels the model is empty: score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, FACTOR, LOWERED, joined, mix, slices, span_hashes, texts_of, word_spans
from .labelled import held_out, training_rows

BUCKETS = 1 << 20
BIAS = BUCKETS


@dataclass(frozen=True)
class Params:
    """``least_texts``: in how many training texts a coordinate must occur to be learnt at all (a feature that a
    few texts own would only learn those texts by heart). ``toxic_weight``: how often a toxic example counts."""

    most_rows: int = 12_000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    least_texts: int = 8
    toxic_weight: float = 2.0
    threshold: float = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of all n-grams and skip-grams, repeated ones included."""
    buffer, text_starts = joined([t.translate(LOWERED) for t in texts])
    starts, ends = word_spans(buffer, ALNUM)
    text = np.searchsorted(text_starts, starts, side="right") - 1
    words = span_hashes(buffer, starts, ends)
    owners, grams = [text], [words]
    for kind, gap in ((1, 1), (2, 2)):  # neighbours; words with one between
        if len(words) > gap:
            same = text[:-gap] == text[gap:]
            pair = mix(words[:-gap] * np.uint64(FACTOR) + words[gap:] + np.uint64(kind))
            owners.append(text[:-gap][same])
            grams.append(pair[same])
    return np.concatenate(owners), (np.concatenate(grams) & np.uint64(BUCKETS - 1)).astype(np.int64)


def distinct_features(texts: list[bytes]) -> list[np.ndarray]:
    owner, coordinate = features(texts)
    both = np.unique(owner.astype(np.int64) * BUCKETS + coordinate)
    return np.split(both % BUCKETS, np.searchsorted(both, np.arange(1, len(texts)) * BUCKETS))


class Ftrl:
    """Per-coordinate state z, n of FTRL-proximal; the weights follow from it."""

    def __init__(self, params: Params):
        self.params = params
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        p, z = self.params, self.z[at]
        l1 = np.where(at == BIAS, 0.0, p.l1)
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        at = np.append(at, BIAS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        g *= self.params.toxic_weight if label else 1.0
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.params.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fit(rows: DataFrame, params: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learnt in one task from the bounded ``rows`` (doc_id, text, label); the bias is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples: list[tuple[int, np.ndarray, float]] = []
        for batch in batches:
            texts, labels = texts_of(batch), batch.column(batch.schema.get_field_index("label")).to_pylist()
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for low, high in slices(texts):
                found = (x.astype(np.int32) for x in distinct_features(texts[low:high]))
                examples.extend(zip((mix_id(i) for i in ids[low:high]), found, labels[low:high]))
        model = Ftrl(params)
        texts_with = np.zeros(BUCKETS, np.int64)
        for _, at, _ in examples:
            texts_with[at] += 1
        common = texts_with >= params.least_texts
        examples = [(key, at[common[at]], label) for key, at, label in examples]
        for epoch in range(params.epochs):
            for _, at, label in sorted(examples, key=lambda e: (e[0] ^ (epoch * FACTOR)) % (1 << 61)):
                model.learn(at, label)
        at = np.append(np.flatnonzero(np.abs(model.z[:BIAS]) > params.l1), BIAS)
        weights = model.weights(at)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights)], ["coordinate", "weight"])

    learnt = rows.repartition(1).mapInArrow(run, "coordinate long, weight double").collect()  # BUCKETS + 1 at most
    at = np.array([r["coordinate"] for r in learnt], np.int64)
    return at, np.array([r["weight"] for r in learnt], np.float64)


def mix_id(value) -> int:
    import zlib

    return zlib.crc32(str(value).encode()) * FACTOR


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = shared.value
        table = np.zeros(BUCKETS + 1, np.float64)
        table[at] = weights
        for batch in batches:
            ids, texts = batch.column(batch.schema.get_field_index("doc_id")), texts_of(batch)
            for low, high in slices(texts):
                owner, coordinate = features(texts[low:high])
                some = table[coordinate] != 0
                both = np.unique(owner[some].astype(np.int64) * BUCKETS + coordinate[some])
                total = np.bincount(both // BUCKETS, table[both % BUCKETS], minlength=high - low) + table[BIAS]
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(score)], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted")
    )


def toxicity(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Learns from ``labels`` (doc_id, toxic) and scores all ``documents`` (doc_id, text)."""
    return score(documents, fit(training_rows(documents, labels, "toxic", params.most_rows), params), params)
