import math
import random

import numpy as np
import pytest

from logyield.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, index string, x int, place double, whitened string"
EXTRA = ("clash", 1, 0.5, "clash")
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def expected(rows, most=8):
    """{vec_id: [(n, deviation, whitened, explained) per component]} by numpy and whole numbers."""
    longest = max(len(v) for _, v in rows if v is not None)
    fit = [(i, v) for i, v in rows if v is not None and len(v) == longest and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in fit], dtype=object)
    n, total = len(fit), x.sum(axis=0)
    off = n * x - total
    centred = np.array(off / n, dtype=float)
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for (i, _), o, c in zip(fit, off, centred):
        out[i] = [(n, sum(int(v) ** 2 for v in o), c @ axes[:, k] / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(most, longest))]
    return out


def compare(got, want):
    assert list(got[0].asDict()) == NAMES
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by_row.keys() == want.keys()
    signs = {}
    for i, parts in want.items():
        assert sorted(by_row[i]) == list(range(1, len(parts) + 1))
        for k, (n, deviation, whitened, explained) in enumerate(parts, 1):
            r = by_row[i][k]
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(explained, rel=1e-9)
            assert r["identity_error"] < 1e-9
            sign = signs.setdefault(k, np.sign(r["whitened"] * whitened) if abs(whitened) > 1e-6 else None)
            if sign is None:
                signs.pop(k)
            else:
                assert r["whitened"] == pytest.approx(sign * whitened, abs=1e-8)


def vectors(seed, n, width):
    dice = random.Random(seed)
    return [(i, [float(np.float32(dice.gauss(0, 1 + j))) for j in range(width)]) for i in range(n)]


def test_against_numpy(spark):
    rows = vectors(1, 700, 12)
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # one very common vector
    odd = [(5000, None), (5001, [1.0] * 11 + [None]), (5002, [1.0] * 11 + [math.nan]), (5003, [math.inf] + [0.0] * 11),
           (5004, []), (5005, [1.0, 2.0])]
    got = whitening.whiten(table(spark, rows + odd).repartition(3)).collect()
    compare(got, expected(rows + odd))


def test_fewer_dimensions_than_components(spark):
    rows = vectors(2, 50, 3)
    compare(whitening.whiten(table(spark, rows)).collect(), expected(rows))


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 64)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    rows = vectors(3, 333, 10)
    compare(whitening.whiten(table(spark, rows).repartition(5)).collect(), expected(rows))


def test_repeated_rows_and_null_ids(spark):
    rows = vectors(4, 40, 4)
    got = whitening.whiten(table(spark, [(7, v) for _, v in rows] + [(None, rows[0][1])] * 2)).collect()
    assert len(got) == 42 * 4
    assert sum(r["vec_id"] is None for r in got) == 8
    assert len({(r["component"], r["whitened"]) for r in got if r["vec_id"] is None}) == 4


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [math.nan])], [(1, [2.0, 3.0])], [(i, [1.0, 1.0]) for i in range(5)]):
        assert whitening.whiten(table(spark, rows)).collect() == []
        assert whitening.whiten(table(spark, rows)).columns == NAMES


def test_directions_without_variance_have_no_component(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(20)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in got} == {1}
    assert all(r["explained"] == pytest.approx(1) for r in got)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e12 * (i % 2), 0.5 * i]) for i in range(40)]
    assert all(r["deviation"] is None for r in whitening.whiten(table(spark, rows)).collect())
