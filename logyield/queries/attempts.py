"""Per-unit retry views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attempts
from ..sources import proxies
from .registry import query
from .sql import KEY, RUNS, RUNS_LARGE, TIME_ASC, TIME_DESC

KEYED = f", keyed AS (SELECT *, {KEY} AS unit_key FROM runs)"
IDENTITY = (
    "unit_id, serial_number, product_code, lot_id, op_id, station_id, host, start_time, end_time, duration_s,"
    " result, error_code, error_message, failing_step, run_folder"
)
FIRST = f"""{KEYED} SELECT unit_key, {IDENTITY} FROM (SELECT *, row_number() OVER (PARTITION BY unit_key
  ORDER BY start_time ASC NULLS FIRST, unit_id) AS rn FROM keyed) WHERE rn = 1"""
LATEST = f"""{KEYED} SELECT unit_key, {IDENTITY} FROM (SELECT *, row_number() OVER (PARTITION BY unit_key
  ORDER BY {TIME_DESC}) AS rn FROM keyed) WHERE rn = 1 ORDER BY {TIME_DESC}"""
GROUPS = f"""{KEYED}, g AS (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY {TIME_DESC}) AS rn,
    count(*) OVER (PARTITION BY unit_key) AS attempt_count,
    count(*) FILTER (WHERE result = 'FAIL') OVER (PARTITION BY unit_key) AS failure_count FROM keyed),
groups AS (SELECT *, CASE WHEN result = 'PASS' AND failure_count > 0 THEN 'retry_pass' WHEN result = 'PASS' THEN 'first_pass'
    WHEN result = 'FAIL' THEN 'fail' ELSE 'unknown' END AS classification FROM g WHERE rn = 1)"""
GROUP_COLUMNS = "unit_key, serial_number, unit_id, classification, result, attempt_count, failure_count"
CLASS_RANK = "CASE classification WHEN 'fail' THEN 0 WHEN 'unknown' THEN 1 WHEN 'retry_pass' THEN 2 ELSE 3 END"
SCALARS = ("unit_key", "serial_number", "unit_id", "classification", "result", "attempt_count", "failure_count")


def groups(spark, sf_dir):
    return attempts.serial_groups(proxies.runs(spark, sf_dir))


@query("first_attempts", f"WITH {RUNS}{FIRST}")
def first_attempts(spark, sf_dir):
    return attempts.first_attempts(proxies.runs(spark, sf_dir))


@query("latest_runs", f"WITH {RUNS}{LATEST}")
def latest_runs(spark, sf_dir):
    return attempts.newest_first(attempts.latest_runs(proxies.runs(spark, sf_dir)))


@query("unit_classification", f"WITH {RUNS}{GROUPS} SELECT unit_key, classification FROM groups")
def unit_classification(spark, sf_dir):
    return groups(spark, sf_dir).select("unit_key", "classification")


@query(
    "serial_groups",
    f"WITH {RUNS}{GROUPS} SELECT {GROUP_COLUMNS}, product_code AS final_product, start_time AS final_start FROM groups",
)
def serial_groups(spark, sf_dir):
    return groups(spark, sf_dir).select(
        *SCALARS, F.col("final.product_code").alias("final_product"), F.col("final.start_time").alias("final_start")
    )


@query("serial_groups_large", f"WITH {RUNS_LARGE}{GROUPS} SELECT {GROUP_COLUMNS} FROM groups")
def serial_groups_large(spark, sf_dir):
    runs = proxies.runs_large(spark, sf_dir)
    return attempts.serial_groups(runs, ("unit_id", "serial_number", "result")).select(*SCALARS)


# Keeps the order itself as a column: position by the sort keys.
@query(
    "engineer_list",
    f"WITH {RUNS}{GROUPS} SELECT {GROUP_COLUMNS} FROM groups ORDER BY {CLASS_RANK}, {TIME_DESC}",
)
def engineer_list(spark, sf_dir):
    return attempts.engineer_order(groups(spark, sf_dir)).select(*SCALARS)


@query(
    "units_of_class",
    f"WITH {RUNS}{GROUPS} SELECT {GROUP_COLUMNS} FROM groups WHERE classification = 'fail'",
)
def units_of_class(spark, sf_dir):
    return attempts.filter_units(groups(spark, sf_dir), classification="fail").select(*SCALARS)


@query(
    "units_of_serial",
    f"""WITH {RUNS}{GROUPS} SELECT {GROUP_COLUMNS} FROM groups
    WHERE coalesce(nullif(serial_number, ''), unit_id) = 'SN7'""",
)
def units_of_serial(spark, sf_dir):
    return attempts.filter_units(groups(spark, sf_dir), serial="SN7").select(*SCALARS)


@query("units_with_failures", f"WITH {RUNS}{GROUPS} SELECT {GROUP_COLUMNS} FROM groups WHERE failure_count > 0")
def units_with_failures(spark, sf_dir):
    return attempts.with_failures(groups(spark, sf_dir)).select(*SCALARS)


FAILURES = f"""{KEYED}, o AS (SELECT *, row_number() OVER (PARTITION BY unit_key ORDER BY {TIME_DESC}) AS back FROM keyed)
SELECT unit_key, unit_id, start_time, end_time, run_folder, serial_number, result,
  row_number() OVER (PARTITION BY unit_key ORDER BY {TIME_ASC}) AS attempt,
  count(*) OVER (PARTITION BY unit_key) AS failures, back = 1 AS is_latest FROM o WHERE result = 'FAIL'"""


@query("failure_attempts", f"WITH {RUNS}{FAILURES}")
def failure_attempts(spark, sf_dir):
    return attempts.failure_attempts(proxies.runs(spark, sf_dir))


@query("failure_attempts_large", f"WITH {RUNS_LARGE}{FAILURES}")
def failure_attempts_large(spark, sf_dir):
    return attempts.failure_attempts(proxies.runs_large(spark, sf_dir))


@query(
    "classification_counts",
    f"""WITH {RUNS}{GROUPS}, c AS (SELECT classification, count(*) AS n FROM groups GROUP BY 1),
    t AS (SELECT (SELECT count(*) FROM runs) AS run_count, (SELECT count(*) FROM groups) AS unique_serial_count)
    SELECT v.classification, coalesce(c.n, 0) AS units, run_count, unique_serial_count
    FROM (VALUES ('fail'), ('unknown'), ('retry_pass'), ('first_pass')) v(classification)
    LEFT JOIN c ON c.classification = v.classification CROSS JOIN t""",
)
def classification_counts(spark, sf_dir):
    return attempts.classification_counts(groups(spark, sf_dir))


@query(
    "distinct_serials",
    f"WITH {RUNS} SELECT DISTINCT coalesce(nullif(serial_number, ''), unit_id) AS serial FROM runs ORDER BY 1",
)
def distinct_serials(spark, sf_dir):
    return attempts.distinct_serials(proxies.runs(spark, sf_dir))
