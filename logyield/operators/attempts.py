"""Retry history of a unit: first attempt, latest run, classification, failure numbering.

A unit is a serial number; a run without one is its own unit. All per-unit
results are min_by/max_by aggregates, so a serial shared by very many runs is
reduced to one row per map task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CLASS_ORDER, FAIL, PASS, RUN_IDENTITY, TIME_ORDER
from .skew import exact_rank


def present(name: str) -> Column:
    """The text column with '' treated as missing."""
    return F.nullif(F.col(name), F.lit(""))


def unit_key() -> Column:
    serial = present("serial_number")
    return F.when(serial.isNotNull(), F.concat(F.lit("serial:"), serial)).otherwise(
        F.concat(F.lit("run:"), F.col("unit_id"))
    )


def display_serial() -> Column:
    return F.coalesce(present("serial_number"), F.col("unit_id"))


def time_position() -> Column:
    """Orderable position of a run; struct ordering puts nulls first."""
    return F.struct(*[F.col(c) for c in TIME_ORDER])


def first_attempts(runs: DataFrame, columns: Sequence[str] = RUN_IDENTITY) -> DataFrame:
    """The earliest run of every unit."""
    return (
        runs.groupBy(unit_key().alias("unit_key"))
        .agg(F.min_by(F.struct(*columns), F.struct("start_time", "unit_id")).alias("r"))
        .select("unit_key", "r.*")
    )


def latest_runs(
    runs: DataFrame, columns: Sequence[str] = RUN_IDENTITY, within: Sequence[str | Column] = ()
) -> DataFrame:
    """The last run of every unit, optionally per further grouping columns."""
    last = runs.groupBy(*within, unit_key().alias("unit_key")).agg(
        F.max_by(F.struct(*columns), time_position()).alias("r")
    )
    return last.select(*[c for c in last.columns if c != "r"], "r.*")


def newest_first(df: DataFrame, prefix: str = "") -> DataFrame:
    return df.orderBy(*[F.col(prefix + c).desc_nulls_last() for c in TIME_ORDER])


def classification(final_result: Column, has_failure: Column) -> Column:
    return (
        F.when((final_result == PASS) & has_failure, "retry_pass")
        .when(final_result == PASS, "first_pass")
        .when(final_result == FAIL, "fail")
        .otherwise("unknown")
    )


def serial_groups(runs: DataFrame, columns: Sequence[str] = RUN_IDENTITY) -> DataFrame:
    """One row per unit: classification, counts and the final run as a struct.

    The failing runs of the unit are the child table of :func:`failure_attempts`;
    they are not collected into an array because one serial may own any number.
    """
    failed = F.col("result") == FAIL
    grouped = runs.groupBy(unit_key().alias("unit_key")).agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.count_if(failed).alias("failure_count"),
        F.max_by(F.struct(*columns), time_position()).alias("final"),
    )
    return grouped.select(
        "unit_key",
        F.col("final.serial_number").alias("serial_number"),
        F.col("final.unit_id").alias("unit_id"),
        classification(F.col("final.result"), F.col("failure_count") > 0).alias("classification"),
        F.col("final.result").alias("result"),
        "attempt_count",
        "failure_count",
        "final",
    )


def engineer_order(groups: DataFrame) -> DataFrame:
    """Failing units first, then unknown, retried and clean ones; newest within."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), F.col("classification"))
    return groups.orderBy(rank, *[F.col(f"final.{c}").desc_nulls_last() for c in TIME_ORDER])


def filter_units(groups: DataFrame, classification: str | None = None, serial: str | None = None) -> DataFrame:
    """Units of one classification and/or one displayed serial."""
    if classification is not None:
        groups = groups.filter(F.col("classification") == classification)
    if serial is not None:
        groups = groups.filter(display_serial() == serial)
    return groups


def with_failures(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("failure_count") > 0)


def failure_attempts(runs: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """Every failing run with "attempt k of n" and whether it is the unit's latest run."""
    wanted = list(dict.fromkeys([*TIME_ORDER, "serial_number", "result", *columns]))
    failed = runs.filter(F.col("result") == FAIL).select(*wanted, unit_key().alias("unit_key"))
    numbered = exact_rank(failed, ["unit_key"], TIME_ORDER, rank="attempt", total="failures")
    # A failing run is the latest when it is the unit's final run, which also
    # rules out retried units: their final run passed.
    finals = (
        runs.groupBy(unit_key().alias("unit_key"))
        .agg(F.max_by(F.struct("unit_id", "result"), time_position()).alias("f"))
        .filter(F.col("f.result") == FAIL)
        .select(F.col("f.unit_id").alias("unit_id"), F.lit(True).alias("_final"))
    )
    return (
        numbered.join(finals, "unit_id", "left")
        .withColumn("is_latest", F.coalesce(F.col("_final"), F.lit(False)))
        .drop("_final")
    )


def classification_counts(groups: DataFrame) -> DataFrame:
    """Units per classification, zeros kept, with the run and unit totals."""
    one = groups.agg(
        *[F.count_if(F.col("classification") == c).alias(c) for c in CLASS_ORDER],
        F.coalesce(F.sum("attempt_count"), F.lit(0)).alias("run_count"),
        F.count(F.lit(1)).alias("unique_serial_count"),
    )
    return one.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("classification"), F.col(c).alias("units")) for c in CLASS_ORDER])
        ).alias("c"),
        "run_count",
        "unique_serial_count",
    ).select("c.classification", "c.units", "run_count", "unique_serial_count")


def distinct_serials(runs: DataFrame) -> DataFrame:
    """Displayed serials in order."""
    return runs.select(display_serial().alias("serial")).distinct().orderBy("serial")
