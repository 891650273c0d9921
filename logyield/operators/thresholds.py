"""Abort detection for APSE runs that end without a verdict block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import failure_snippet
from ..schema import FAIL, PASS
from .attempts import present
from .skew import salted_lookup

# Share of the average passing duration, and its lower bound in seconds.
ABORT_FACTOR = 0.05
ABORT_FLOOR_S = 5.0
# Fixed value: the message of an aborted run, which its failure signature is made of.
ABORT_MESSAGE = "FTRunner aborted before test completed (duration: %.3fs, threshold: %.1fs)."
KEYS = ("product_key", "op_key")


def _keyed(runs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return runs.withColumns(
        {"product_key": F.coalesce(present("product_code"), empty), "op_key": F.coalesce(present("op_id"), empty)}
    )


def _is_apse():
    return F.upper(F.coalesce("test_mode", F.lit(""))) == "APSE"


def abort_thresholds(runs: DataFrame) -> DataFrame:
    """Per product and operation: max(floor, factor × mean duration of explicit passes).

    Durations are summed as decimals, which makes the mean independent of the
    order in which partial sums arrive.
    """
    passes = _keyed(runs).filter(
        _is_apse() & F.col("has_done_block") & (F.col("result") == PASS) & F.col("total_test_time_s").isNotNull()
    )
    total = F.sum(F.col("total_test_time_s").cast("decimal(18,6)")).cast("double")
    return passes.groupBy(*KEYS).agg(
        F.greatest(F.lit(ABORT_FLOOR_S), total / F.count(F.lit(1)) * ABORT_FACTOR).alias("threshold_s"),
        F.count(F.lit(1)).alias("passes"),
    )


def reclassify_aborts(runs: DataFrame, thresholds: DataFrame, include_explicit: bool = False) -> DataFrame:
    """Turn too-short APSE passes into failures; the snippet is rebuilt for them.

    ``include_explicit`` also re-examines runs whose verdict block said PASS.
    """
    joined = salted_lookup(
        _keyed(runs), thresholds.select(*KEYS, "threshold_s"), KEYS, spread=["unit_id"]
    ).withColumn("_limit", F.coalesce("threshold_s", F.lit(ABORT_FLOOR_S)))
    aborted = (F.col("result") == PASS) & _is_apse() & (F.col("duration_s") < F.col("_limit"))
    if not include_explicit:
        aborted = aborted & ~F.coalesce("has_done_block", F.lit(False))
    message = F.format_string(ABORT_MESSAGE, F.bround("duration_s", 3), F.bround("_limit", 1))
    out = joined.withColumn("aborted", aborted).withColumns(
        {
            "result": F.when(F.col("aborted"), FAIL).otherwise(F.col("result")),
            "error_code": F.when(F.col("aborted"), "UNKNOWN").otherwise(F.col("error_code")),
            "error_message": F.when(F.col("aborted"), message).otherwise(F.col("error_message")),
        }
    )
    if "ftrunner_snippet" in runs.columns:
        rebuilt = failure_snippet(*[F.col(c) for c in ("result", "failing_step", "error_code", "error_message")])
        out = out.withColumn(
            "ftrunner_snippet", F.when(F.col("aborted"), rebuilt).otherwise(F.col("ftrunner_snippet"))
        )
    return out.drop(*KEYS, "_limit", "threshold_s")
