"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into chunks of ``CHUNK`` bytes that overlap by one filter width, so every byte sequence a filter can see
lies inside some chunk and the chunks cover the whole text. ``FILTERS`` learned filters of ``WIDTH`` bytes slide over a
chunk in steps of ``STEP``; each response is a sum of one learned number per (place, byte), passed through a rectifier and
max-pooled over the chunk. The chunks of a text are combined by maximum and by mean of their pooled responses, and a
logistic layer turns both into one probability.

Training (Adam, exact gradients through the pooled places) runs in one task on a bounded sample: ``Params.most_rows``
labelled ids outside the held-out fold, in the order of their ids' hashes, each with all its chunks. A row whose chunks do not
fit into what is left of ``Params.most_chunks`` for the whole sample is not part of it. Scoring reads all chunks of every text. Empty and null texts are one chunk of padding and get a score like any other.
Repeated rows are scored one by one, extra columns are not read, an empty table gives an empty result. Without labels
the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, tidy
from .labelled import held_out, training_rows

WIDTH, STEP, FILTERS = 8, 2, 16
CHUNK = 512
PLACES = (CHUNK - WIDTH) // STEP + 1
ADVANCE = CHUNK - WIDTH


@dataclass(frozen=True)
class Params:
    most_rows: int = 4_000
    most_chunks: int = 32_000
    epochs: int = 8
    rate: float = 0.01
    batch: int = 64
    decay: float = 1e-4
    threshold: float = 0.7


def chunk_count(length: int) -> int:
    return 1 + max(0, -(-(length - CHUNK) // ADVANCE))


def chunks_of(text: bytes, which: list[int] | range) -> bytes:
    """The chosen chunks side by side, the last one filled up with zero bytes."""
    return b"".join(text[c * ADVANCE : c * ADVANCE + CHUNK].ljust(CHUNK, b"\0") for c in which)


def responses(chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(chunks, places, filters): sums of ``tables[k, byte]`` over the ``WIDTH`` places k of a filter."""
    out = tables[0][chunks[:, 0 : PLACES * STEP : STEP]]
    for k in range(1, WIDTH):
        out += tables[k][chunks[:, k : k + (PLACES - 1) * STEP + 1 : STEP]]
    return out


def pooled(chunks: np.ndarray, tables: np.ndarray, lot: int = 64) -> np.ndarray:
    out = np.empty((len(chunks), FILTERS), np.float32)
    for low in range(0, len(chunks), lot):
        out[low : low + lot] = responses(chunks[low : low + lot], tables).max(axis=1)
    return out


def combined(rectified: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, 2 * filters): maximum and mean over the chunks of each text; every text has a chunk."""
    most = np.maximum.reduceat(rectified, bounds[:-1], axis=0)
    mean = np.add.reduceat(rectified, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
    return np.concatenate([most, mean], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.shift, self.out, self.bias]

    def load(self, raw: bytes) -> Network:
        flat, at = np.frombuffer(raw, np.float32), 0
        for part in self.parts():
            part[...] = flat[at : at + part.size].reshape(part.shape)
            at += part.size
        return self

    def dump(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).tobytes()

    def probabilities(self, chunks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rectified = np.maximum(pooled(chunks, self.tables) + self.shift, 0)
        return sigmoid((combined(rectified, bounds) @ self.out + self.bias[0]).astype(np.float64))

    def gradients(self, chunks: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        values = responses(chunks, self.tables)
        place = values.argmax(axis=1)
        before = np.take_along_axis(values, place[:, None, :], axis=1)[:, 0, :] + self.shift
        rectified = np.maximum(before, 0)
        seen = combined(rectified, bounds)
        error = ((sigmoid(seen @ self.out + self.bias[0]) - labels) * weights / len(labels)).astype(np.float32)
        text = np.repeat(np.arange(len(labels)), np.diff(bounds))
        is_most = rectified == seen[text, :FILTERS]
        back = is_most * (error[:, None] * self.out[:FILTERS])[text]
        back += (error[:, None] * self.out[FILTERS:] / np.diff(bounds)[:, None])[text]
        back *= before > 0
        tables = np.zeros_like(self.tables)
        rows = np.arange(len(chunks))[:, None]
        for k in range(WIDTH):
            np.add.at(tables[k], (chunks[rows, place * STEP + k], np.arange(FILTERS)[None, :]), back)
        return [tables, back.sum(axis=0), error @ seen, error.sum(keepdims=True)]

    def train(self, examples: list[tuple[bytes, float]], params: Params) -> None:
        labels = np.array([y for _, y in examples], np.float32)
        counts = np.array([len(x) // CHUNK for x, _ in examples])
        share = labels.mean()
        if not 0 < share < 1:
            return
        first = [np.zeros_like(p) for p in self.parts()]
        second = [np.zeros_like(p) for p in self.parts()]
        rng, step = np.random.default_rng(11), 0
        for epoch in range(params.epochs):
            order = rng.permutation(len(examples))
            rate = params.rate * (1 - epoch / params.epochs)
            for low in range(0, len(order), params.batch):
                some = order[low : low + params.batch]
                raw = np.frombuffer(b"".join(examples[i][0] for i in some), np.uint8).reshape(-1, CHUNK)
                bounds = np.r_[0, np.cumsum(counts[some])]
                y = labels[some]
                weights = np.where(y > 0, 1.0, min(4.0, share / (1 - share)) if share > 0.5 else 1.0)
                step += 1
                for k, (part, grad) in enumerate(zip(self.parts(), self.gradients(raw, bounds, y, weights))):
                    grad = grad + params.decay * part
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    m, v = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                    part -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def fit(rows: DataFrame, params: Params = Params()) -> bytes | None:
    """The network's numbers, learnt in one task from the bounded ``rows`` (doc_id, text, label); None without rows."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(texts := texts_of(batch)):
                fits = [i for i in range(low, high) if chunk_count(len(texts[i])) <= params.most_chunks]
                chosen = [chunks_of(texts[i], range(chunk_count(len(texts[i])))) for i in fits]
                others = (batch.column(batch.schema.get_field_index(n)).take(pa.array(fits, pa.int64())) for n in ("_order", "doc_id", "label"))
                order, ids, label = others
                names = ["_order", "id", "chunks", "label"]
                yield pa.RecordBatch.from_arrays([order, ids.cast(pa.string()), pa.array(chosen, pa.binary()), label], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, left = [], params.most_chunks * CHUNK
        for batch in batches:
            for _, key, chunks, label in zip(*(batch.column(i) for i in range(4))):
                if (size := len(chunks.as_buffer())) <= left:
                    left -= size
                    examples.append((key.as_py(), chunks.as_py(), label.as_py()))
        if examples:
            network = Network()
            network.train([(chunks, label) for _, chunks, label in sorted(examples)], params)
            yield pa.RecordBatch.from_arrays([pa.array([network.dump()], pa.binary())], ["network"])

    hashed = rows.select("doc_id", "text", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("_order"))
    few = hashed.mapInArrow(sample, "_order long, id string, chunks binary, label double")
    few = few.repartition(1).sortWithinPartitions("_order", "id", "chunks", "label")
    learnt = few.mapInArrow(run, "network binary").collect()  # at most one row of a fixed size
    return learnt[0]["network"] if learnt else None


def with_scores(documents: DataFrame, network: bytes | None) -> DataFrame:
    """All columns of ``documents`` plus ``_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(network)
    schema = ", ".join(f"`{n}` {kind}" for n, kind in documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network().load(shared.value) if shared.value else None
        for batch in batches:
            texts = texts_of(batch)
            score = np.full(len(texts), 0.5)
            for low, high in slices(texts) if model else ():
                counts = np.array([chunk_count(len(t)) for t in texts[low:high]])
                raw = b"".join(chunks_of(t, range(n)) for t, n in zip(texts[low:high], counts))
                score[low:high] = model.probabilities(
                    np.frombuffer(raw, np.uint8).reshape(-1, CHUNK), np.r_[0, np.cumsum(counts)]
                )
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "_score"])

    return documents.mapInArrow(tidy(run), f"{schema}, `_score` double")


def score(documents: DataFrame, network: bytes | None, params: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = with_scores(documents.select("doc_id", "text"), network)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= params.threshold).cast("int").alias("predicted"),
    )


def classify(documents: DataFrame, labels: DataFrame, params: Params = Params()) -> DataFrame:
    """Learns from ``labels`` (doc_id, quality) and scores all ``documents`` (doc_id, text)."""
    return score(documents, fit(training_rows(documents, labels, "quality", params.most_rows), params), params)
