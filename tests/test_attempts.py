"""Retry views: literal cases and brute force over random runs with one very hot serial."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logyield.operators import attempts, thresholds, yields
from logyield.operators.skew import exact_rank, ranked_within, salted_lookup
from logyield.plans.manager import manager_view
from logyield.sources import proxies
from tests.conftest import SMALL

SCHEMA = (
    "unit_id string, serial_number string, product_code string, lot_id string, op_id string, station_id string,"
    " host string, start_time timestamp_ntz, end_time timestamp_ntz, duration_s double, result string,"
    " error_code string, error_message string, failing_step string, run_folder string"
)


def run(unit, serial, result, start=None, end=None, folder="", **more):
    row = dict.fromkeys([c.strip().split()[0] for c in SCHEMA.split(",")])
    row.update(unit_id=unit, serial_number=serial, result=result, start_time=start, end_time=end, run_folder=folder, **more)
    return row


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


T10, T11 = dt.datetime(2026, 1, 1, 10), dt.datetime(2026, 1, 1, 11)
CASES = [
    run("a1", "SNA", "PASS", T10),
    run("b1", "SNB", "FAIL", T10),
    run("b2", "SNB", "PASS", T11),
    run("c1", "SNC", "FAIL", T10),
    run("c2", "SNC", "FAIL", T11),
    run("d1", "SND", "PASS", T10),
    run("d2", "SND", "FAIL", T11),
    run("u1", "SNU", "UNKNOWN", T10),
    run("x1", None, "PASS", T10),
    run("x2", "", "FAIL", T10),
]


def test_classification(spark):
    rows = {r.unit_id: r for r in attempts.serial_groups(frame(spark, CASES)).collect()}
    assert {u: r.classification for u, r in rows.items()} == {
        "a1": "first_pass", "b2": "retry_pass", "c2": "fail", "d2": "fail", "u1": "unknown", "x1": "first_pass", "x2": "fail",
    }
    assert (rows["c2"].attempt_count, rows["c2"].failure_count) == (2, 2)
    ordered = attempts.engineer_order(attempts.serial_groups(frame(spark, CASES))).select("classification").collect()
    order = ["fail", "unknown", "retry_pass", "first_pass"]
    assert [order.index(r[0]) for r in ordered] == sorted(order.index(r[0]) for r in ordered)


def test_empty_input(spark):
    empty = frame(spark, CASES).filter("false")
    s = yields.manager_summary(empty).first()
    assert (s.total_runs, s.unique_units, s.fpy, s.retests) == (0, 0, 0.0, 0)
    view = manager_view(empty)
    assert all(view[k].count() == 0 for k in ("trend", "pareto", "stations", "lots"))
    assert {r.units for r in attempts.classification_counts(attempts.serial_groups(empty)).collect()} == {0}


def test_product_summary(spark):
    rows = [run(f"SN{i}", f"SN{i}", r, product_code="K") for i, r in enumerate(["PASS", "PASS", "FAIL", "FAIL"])]
    s = yields.product_summary(frame(spark, rows)).first()
    assert (s.total, s["pass"], s.fail, s.final_yield) == (4, 2, 2, 50.0)


def test_rounding_is_half_even_on_exact_ties(spark):
    rows = [run(f"u{i}", f"s{i}", "PASS" if i == 0 else "FAIL") for i in range(32)]
    assert yields.manager_summary(frame(spark, rows)).first().fpy == 3.12


def test_pareto_labels(spark):
    rows = [
        run("1", "a", "FAIL", error_code="E1", error_message="m" * 80),
        run("2", "b", "FAIL", error_message="only message"),
        run("3", "c", "FAIL", error_code="E2"),
        run("4", "d", "FAIL"),
        run("5", "e", "FAIL", error_code="", error_message=""),
        run("6", "f", "PASS", error_code="E2"),
    ]
    got = {r.reason: (r["count"], r.pct, r.cum_pct) for r in yields.failure_pareto(frame(spark, rows)).collect()}
    assert set(got) == {"E1: " + "m" * 60, "FAIL: only message", "E2", "UNKNOWN"}
    assert got["UNKNOWN"] == (2, 40.0, 40.0) and max(v[2] for v in got.values()) == 100.0
    assert [r.reason for r in yields.failure_pareto(frame(spark, rows), 1).collect()] == ["UNKNOWN"]


def order_of(r):
    none_first = lambda v: (v is not None, v)
    return tuple(none_first(r[c]) for c in ("start_time", "end_time", "run_folder", "unit_id"))


@pytest.fixture(scope="module")
def random_runs():
    """A third of the runs share one serial; many have no start, no end or neither."""
    rnd = random.Random(7)
    base = dt.datetime(2026, 1, 1)
    rows = []
    for i in range(900):
        serial = "HOT" if i % 3 == 0 else rnd.choice([None, "", *[f"S{k}" for k in range(40)]])
        moment = lambda: rnd.choice([None, base + dt.timedelta(minutes=rnd.randrange(0, 4000))])
        rows.append(
            run(f"u{rnd.randrange(10**6)}-{i}", serial, rnd.choice(["PASS", "FAIL", "UNKNOWN"]), moment(), moment(),
                folder=f"folder{rnd.randrange(30)}/" + "x" * rnd.randrange(40), product_code=rnd.choice(["P1", "P2"]))
        )
    return rows


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["serial_number"] or r["unit_id"], []).append(r)
    return {k: sorted(v, key=order_of) for k, v in out.items()}


def test_failure_numbering_brute_force(spark, random_runs):
    want = {}
    for ordered in groups_of(random_runs).values():
        failed = [r for r in ordered if r["result"] == "FAIL"]
        for k, r in enumerate(failed, 1):
            want[r["unit_id"]] = (k, len(failed), r is ordered[-1])
    got = {
        r.unit_id: (r.attempt, r.failures, r.is_latest)
        for r in attempts.failure_attempts(frame(spark, random_runs)).collect()
    }
    assert got == want


def test_first_and_latest_brute_force(spark, random_runs):
    groups = groups_of(random_runs)
    latest = {r.unit_id for r in attempts.latest_runs(frame(spark, random_runs)).collect()}
    assert latest == {g[-1]["unit_id"] for g in groups.values()}
    key = lambda r: ((r["start_time"] is not None, r["start_time"]), r["unit_id"])
    first = {r.unit_id for r in attempts.first_attempts(frame(spark, random_runs)).collect()}
    assert first == {min(g, key=key)["unit_id"] for g in groups.values()}
    counts = {r.classification: r.units for r in attempts.classification_counts(
        attempts.serial_groups(frame(spark, random_runs))).collect()}
    assert sum(counts.values()) == len(groups)


def test_manager_invariants(spark, random_runs):
    s = yields.manager_summary(frame(spark, random_runs)).first()
    assert s.passed + s.failed + s.unknown == s.total_runs == len(random_runs)
    assert s.unique_units == len(groups_of(random_runs)) and s.retests == s.total_runs - s.unique_units
    cumulative = [r.cum_pct for r in yields.failure_pareto(frame(spark, random_runs)).collect()]
    assert cumulative == sorted(cumulative)


def test_ranked_within_brute_force(spark):
    rows = [(i % 3 and "a" or "b", i * 7 % 501) for i in range(501)]
    df = spark.createDataFrame(rows, "k string, seq int")
    out = ranked_within(df, ["k"], ["seq"], [F.floor(F.col("seq") / 10).alias("_b0")], rank="r", total="n").collect()
    for key in "ab":
        ordered = sorted(s for k, s in rows if k == key)
        assert sorted((x.r, x.seq, x.n) for x in out if x.k == key) == [(i, s, len(ordered)) for i, s in enumerate(ordered, 1)]


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("min_rows", [1, 100, 10**9])
def test_salted_lookup_equals_plain_join(spark, how, min_rows):
    big = spark.range(1000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    small = spark.createDataFrame([("hot", 1), ("k4", 2), ("k8", 3), ("absent", 4)], "k string, v int")
    counted = big.groupBy("k").agg(F.count(F.lit(1)).alias("_rows"))
    got = salted_lookup(big, small, ["k"], ["id"], how=how, counted=counted, min_rows=min_rows)
    want = big.join(small, "k", how)
    assert sorted(map(repr, got.select("id", "k", "v").collect())) == sorted(map(repr, want.select("id", "k", "v").collect()))


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation [")


def test_lookups_read_no_input_twice(spark):
    large = proxies.runs_large(spark, SMALL, "product_code", "host", "lot_id")
    assert scans(large) <= 6  # lineitem, part, supplier, nation, orders
    runs = proxies.runs(spark, SMALL)
    assert scans(thresholds.reclassify_aborts(runs, thresholds.abort_thresholds(runs))) <= 2


def test_rank_of_one_serial_at_one_moment(spark):
    """A third of the rows share key and time: the ranges cut them apart, and the ranks are exact."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("at"),
        F.when(F.col("id") % 6 == 0, None).otherwise(F.col("id") % 5).alias("end"),
        F.col("id"),
    )
    out = exact_rank(rows, ["k"], ["at", "end", "id"], rank="r", total="n")
    frame = out.toPandas().sort_values(["k", "at", "end", "id"], na_position="first")
    assert len(frame) == 30_000
    assert (frame["r"] == frame.groupby("k").cumcount() + 1).all()
    assert (frame["n"] == frame.groupby("k")["id"].transform("size")).all()
    ranged = rows.repartitionByRange(8, F.col("k"), F.col("at"), F.col("end"), F.col("id"))
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 30_000 / 8


def test_manager_view_scans_twice(spark, tmp_path):
    from logyield.sources import proxies
    from tests.conftest import SMALL

    path = f"{tmp_path}/runs"
    proxies.runs(spark, SMALL).write.parquet(path)
    view = manager_view(spark.read.parquet(path))
    scans = sum(df._jdf.queryExecution().executedPlan().toString().count(path) for df in view.values())
    assert scans == 1  # and one for the stored counts
