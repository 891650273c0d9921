import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logyield.llm import labelled, quality, toxicity
from logyield.llm.common import table

HALF = "/root/testdata/sf0.1"
ODD = [(None, None, "x"), (1, "", "x"), (2, None, "x"), (3, "a" * 5000, "x"), (3, "a" * 5000, "x"), (4, "idiot", "x")]


def rates(got, labels, label):
    truth = {r.doc_id: r[label] for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    right = sum(p == t for p, t in held) / len(held)
    found = [p for p, t in held if t]
    return right, sum(found) / len(found)


def test_folds(spark):
    got = spark.range(200).select("id", labelled.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def test_training_rows_are_bounded_and_agree(spark):
    documents = spark.createDataFrame([(i, f"t{i}") for i in range(100)] + [(None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(0, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    rows = labelled.training_rows(documents, labels, "quality", 20).collect()
    assert len(rows) == 20
    assert all(r.doc_id and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.label == r.doc_id % 2 for r in rows)


def test_toxicity_on_held_out_labels(spark):
    labels = table(spark, HALF, "labels")
    got = toxicity.toxicity(table(spark, HALF, "documents"), labels).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right, found = rates(got, labels, "toxic")
    assert right > 0.94 and found > 0.65


def test_quality_on_held_out_labels(spark):
    labels = table(spark, HALF, "labels")
    got = quality.classify(table(spark, HALF, "documents"), labels).collect()
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    right, found = rates(got, labels, "quality")
    assert right > 0.97 and found > 0.97


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.classify])
def test_edges(spark, score):
    documents = spark.createDataFrame(ODD, "doc_id bigint, text string, score string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = score(documents, none).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    one = spark.createDataFrame([(1, 1, 1), (3, 1, 1), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert len(score(documents, one).collect()) == len(ODD)
    assert score(documents.limit(0), one).collect() == []


def test_ftrl_finds_the_word():
    dice = random.Random(1)
    words = ["".join(dice.choices("abcdef", k=4)) for _ in range(200)]
    model = toxicity.Ftrl(toxicity.Params(l1=1.0))
    texts = [(" ".join(dice.choices(words, k=30) + (["idiot"] if i % 4 == 0 else [])), i % 4 == 0) for i in range(600)]
    for text, label in texts:
        model.learn(toxicity.distinct_features([text.encode()])[0], float(label))
    at = toxicity.distinct_features([b"idiot"])[0]
    assert model.weights(at)[0] > 1
    assert (np.abs(model.z[: toxicity.BUCKETS]) > 1).sum() < 2000


def test_features_are_words_pairs_and_skips():
    owner, coordinate = toxicity.features([b"One two THREE", b"", b"one"])
    assert np.bincount(owner, minlength=3).tolist() == [3 + 2 + 1, 0, 1]
    assert coordinate[owner == 2][0] in coordinate[owner == 0]


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(0)
    network = quality.Network()
    chunks = rng.integers(97, 110, (5, quality.CHUNK)).astype(np.uint8)
    bounds, labels, weights = np.array([0, 2, 3, 5]), np.array([1, 0, 1], np.float32), np.array([1, 2, 1], np.float32)

    def loss():
        p = network.probabilities(chunks, bounds)
        return float((weights * -(labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum() / 3)

    found = network.gradients(chunks, bounds, labels, weights)
    for part, gradient in zip(network.parts(), found):
        for place in [np.unravel_index(i, part.shape) for i in np.argsort(-np.abs(gradient).ravel())[:3]]:
            before = part[place]
            part[place] = before + 1e-2
            up = loss()
            part[place] = before - 1e-2
            down = loss()
            part[place] = before
            assert abs((up - down) / 2e-2 - gradient[place]) < 0.05 * abs(gradient[place]) + 2e-4


def test_chunks_cover_the_text_with_overlap():
    for n in (0, 1, 511, 512, 513, 1016, 1017, 5000):
        text = bytes(i % 251 for i in range(n))
        count = quality.chunk_count(n)
        raw = quality.chunks_of(text, range(count))
        assert len(raw) == count * quality.CHUNK
        joined = raw[: quality.CHUNK] + b"".join(
            raw[k * quality.CHUNK + quality.WIDTH : (k + 1) * quality.CHUNK] for k in range(1, count)
        )
        assert joined[:n] == text


def test_training_takes_whole_texts_within_its_bound(spark):
    texts = ["good " * 40, "bad### " * 400, "good words " * 3000] * 6
    rows = [(i, t, float("#" not in t)) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label double").repartition(3)
    order = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("h")).collect()}
    for most in (1, 40, 150, 10_000):
        params = quality.Params(most_chunks=most, epochs=1)
        left, chosen = most, []
        for key, text, label in sorted(rows, key=lambda r: order[r[0]]):
            n = quality.chunk_count(len(text))
            if n <= left:
                left -= n
                chosen.append((str(key), quality.chunks_of(text.encode(), range(n)), label))
        network = quality.Network()
        network.train([(c, y) for _, c, y in sorted(chosen)], params)
        assert quality.fit(frame, params) == (network.dump() if chosen else None)
