"""Yield summary, daily yield, failure Pareto, station and lot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import FAIL, PASS, UNKNOWN
from ..session import stored
from .attempts import present, unit_key
from .skew import ranked_within, salted_lookup

# Characters of the message kept in a Pareto label, default rows.
LABEL_MESSAGE_CHARS = 60
PARETO_TOP = 10


def percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, two places, 0.0 when there is nothing."""
    return F.when(whole > 0, F.bround(part / whole * 100.0, 2)).otherwise(0.0)


def is_result(value: str) -> Column:
    return F.col("result") == value


def manager_summary(runs: DataFrame) -> DataFrame:
    """Run totals and first-pass yield (first attempt of each unit, PASS or FAIL only)."""
    per_unit = runs.groupBy(unit_key().alias("unit_key")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(is_result(PASS)).alias("passed"),
        F.count_if(is_result(FAIL)).alias("failed"),
        F.count_if(is_result(UNKNOWN)).alias("unknown"),
        F.min_by("result", F.struct("start_time", "unit_id")).alias("first_result"),
    )
    first = F.col("first_result")
    totals = per_unit.agg(
        F.coalesce(F.sum("runs"), F.lit(0)).alias("total_runs"),
        F.count(F.lit(1)).alias("unique_units"),
        F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"),
        F.count_if(first == PASS).alias("fpy_pass"),
        F.count_if(first.isin(PASS, FAIL)).alias("fpy_total"),
    )
    return totals.withColumns(
        {
            "fpy": percent(F.col("fpy_pass"), F.col("fpy_total")),
            "retests": F.col("total_runs") - F.col("unique_units"),
        }
    )


def day() -> Column:
    return F.date_format("start_time", "yyyy-MM-dd")


def station_label() -> Column:
    return F.concat(
        F.coalesce(present("host"), F.lit("unknown")),
        F.lit(" / ST"),
        F.coalesce(present("station_id"), F.lit("?")),
    )


def lot_label() -> Column:
    return F.coalesce(present("lot_id"), F.lit("unknown"))


def failure_label() -> Column:
    code, message = present("error_code"), present("error_message")
    return F.when(
        message.isNotNull(),
        F.concat(F.coalesce(code, F.lit("FAIL")), F.lit(": "), F.substring(message, 1, LABEL_MESSAGE_CHARS)),
    ).otherwise(F.coalesce(code, F.lit("UNKNOWN")))


def _pass_fail(runs: DataFrame, label: Column, name: str) -> DataFrame:
    """PASS and FAIL runs per label; other results never open a group."""
    return (
        runs.filter(F.col("result").isin(PASS, FAIL))
        .groupBy(label.alias(name))
        .agg(F.count_if(is_result(PASS)).alias("pass"), F.count_if(is_result(FAIL)).alias("fail"))
        .withColumn("total", F.col("pass") + F.col("fail"))
        .withColumn("yield", percent(F.col("pass"), F.col("total")))
    )


def daily_yield(runs: DataFrame) -> DataFrame:
    """All PASS/FAIL runs per calendar day of their start."""
    dated = runs.filter(F.col("start_time").isNotNull())
    return _pass_fail(dated, day(), "date").drop("total").orderBy("date")


def station_breakdown(runs: DataFrame) -> DataFrame:
    return _pass_fail(runs, station_label(), "station").orderBy("station")


def lot_comparison(runs: DataFrame) -> DataFrame:
    return _pass_fail(runs, lot_label(), "lot").orderBy("lot")


def failure_pareto(runs: DataFrame, top: int = PARETO_TOP) -> DataFrame:
    """Most frequent failure labels with share and cumulative share of all failures."""
    counted = (
        runs.filter(is_result(FAIL))
        .select(failure_label().alias("reason"))
        .rollup("reason")
        .agg(F.count(F.lit(1)).alias("count"), F.grouping("reason").alias("is_total"))
    )
    return ranked_shares(counted, top)


def cumulative_shares(runs: DataFrame) -> DataFrame:
    """All failure labels with share and cumulative share, most frequent first.

    Labels may be many, so none of this sorts them in one task: labels of one
    count are ranked within the first letters of their text, and only the distinct
    counts (few, as they add up to the failures) are accumulated in order.
    """
    counted = runs.filter(is_result(FAIL)).groupBy(failure_label().alias("reason")).agg(F.count(F.lit(1)).alias("count"))
    labels = stored(counted, "labels")  # ranks and sums both read them; the runs are read once
    ranked = ranked_within(labels, ["count"], ["reason"], [F.substring("reason", 1, 12)], rank="_rank", total="_same")
    per_count = labels.groupBy("count").agg(F.count(F.lit(1)).alias("_labels"))
    before = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    weight = F.col("count") * F.col("_labels")
    sums = per_count.select(
        "count", F.coalesce(F.sum(weight).over(before), F.lit(0)).alias("_before"), F.sum(weight).over(whole).alias("_all")
    )
    counted = per_count.withColumnRenamed("_labels", "_rows")
    found = salted_lookup(ranked, sums, ["count"], spread=["reason"], how="inner", counted=counted)
    return found.select(
        "reason",
        "count",
        percent(F.col("count"), F.col("_all")).alias("pct"),
        percent(F.col("_before") + F.col("_rank") * F.col("count"), F.col("_all")).alias("cum_pct"),
    )


def ranked_shares(counted: DataFrame, top: int) -> DataFrame:
    """Rank labels by count and accumulate their share.

    ``counted`` holds one grand-total row beside the labels. It sorts first, so
    ``top + 1`` rows are all the cumulative window ever sees.
    """
    head = counted.orderBy(F.col("is_total").desc(), F.col("count").desc(), F.col("reason")).limit(top + 1)
    everything = F.max(F.when(F.col("is_total") == 1, F.col("count"))).over(Window.partitionBy())
    so_far = Window.orderBy(F.col("is_total").desc(), F.col("count").desc(), F.col("reason")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cumulative = F.sum(F.when(F.col("is_total") == 0, F.col("count"))).over(so_far)
    return (
        head.withColumns({"_all": everything, "_cum": cumulative})
        .filter(F.col("is_total") == 0)
        .select(
            "reason",
            "count",
            percent(F.col("count"), F.col("_all")).alias("pct"),
            percent(F.col("_cum"), F.col("_all")).alias("cum_pct"),
        )
        .orderBy(F.col("count").desc(), "reason")
    )


def product_summary(runs: DataFrame) -> DataFrame:
    """Outcome of the latest run of each unit, per product."""
    product = F.coalesce(present("product_code"), F.lit("UNKNOWN"))
    per_unit = runs.groupBy(product.alias("product_code"), unit_key().alias("unit_key")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max_by("result", F.struct("start_time", "end_time", "run_folder", "unit_id")).alias("result"),
    )
    return (
        per_unit.groupBy("product_code")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(is_result(PASS)).alias("pass"),
            F.count_if(is_result(FAIL)).alias("fail"),
            F.sum("runs").alias("run_count"),
        )
        .withColumns(
            {
                "unknown": F.col("total") - F.col("pass") - F.col("fail"),
                "final_yield": percent(F.col("pass"), F.col("total")),
                "retests": F.col("run_count") - F.col("total"),
            }
        )
        .orderBy("product_code")
    )

