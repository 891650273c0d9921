"""Parser round trips: logs are written from ``runs`` and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kv import DONE_HEADER, SCAN_HEADER
from ..functions.redaction import redact
from ..functions.text import cap
from ..plans import parse, parse_lines
from ..session import stored
from ..sources import proxies
from .registry import query
from .sql import KEEP_SERIAL, RUNS, redact_sql

# What the rendered log of a run says, column by column.
LOGGED = f"""{RUNS}, l AS (SELECT *, CAST(unit_id AS BIGINT) AS e, has_done_block OR result = 'UNKNOWN' AS explicit,
    date_trunc('second', coalesce(start_time, TIMESTAMP '2024-01-01 00:00:00')) AS t0 FROM runs),
m AS (SELECT *, CAST(t0 + to_seconds(e % 600) AS TIMESTAMP) AS ends, result = 'FAIL' AS failed,
    explicit AND e % 3 = 1 AS has_end FROM l),
parsed AS (SELECT left(sha1(run_folder), 16) AS unit_id, run_folder, serial_number, product_code, op_id, station_id, host,
    'TP' || (e % 3) AS tp_name, 'V' || (e % 10) AS tp_version, test_mode,
    coalesce(lot_id, 'STC') AS lot_id, CAST(t0 AS TIMESTAMP) AS start_time, ends AS end_time,
    CASE WHEN has_end THEN strftime(ends, '%Y%m%d%H%M%S') END AS end_time_raw,
    CAST(e % 600 AS DOUBLE) AS duration_s, 'clock' AS duration_basis,
    CASE WHEN e % 9 <> 8 THEN CAST(e % 3000 AS DOUBLE) ELSE 0e0 END + 7e0 AS step_duration_s,
    CAST(printf('%.2f', total_test_time_s) AS DOUBLE) AS total_test_time_s, result, explicit AS has_done_block,
    CASE WHEN failed AND explicit THEN error_code WHEN failed THEN 'UNKNOWN' END AS error_code,
    CASE WHEN failed AND explicit THEN error_message
      WHEN failed THEN 'FTRunner reported an error (see source log for detail).' END AS error_message,
    CASE WHEN failed THEN 'Thermal Test' END AS failing_step,
    CASE WHEN e % 10 = 7 THEN 'pan' ELSE 'aic' END AS device_class, e
  FROM m)
"""
IDENTITY = "unit_id, run_folder, serial_number, product_code, op_id, station_id, host, tp_name, tp_version, test_mode, lot_id"
TIMES = "unit_id, start_time, end_time, end_time_raw, duration_s, duration_basis, step_duration_s, total_test_time_s"
VERDICT = "unit_id, result, has_done_block, error_code, error_message, failing_step, device_class"


def parsed(spark, sf_dir):
    return parse.one_log_per_folder(parse.parse_logs(proxies.logs(spark, sf_dir)))


for _name, _columns in (("parse_identity", IDENTITY), ("parse_times", TIMES), ("parse_verdicts", VERDICT)):
    query(_name, f"WITH {LOGGED} SELECT {_columns} FROM parsed")(
        lambda spark, sf_dir, columns=_columns: parsed(spark, sf_dir).select(*columns.split(", "))
    )


@query(
    "parse_snippets",
    f"""WITH {LOGGED} SELECT unit_id, CASE WHEN result = 'FAIL' THEN concat_ws(chr(10), 'Result: FAIL',
    'Failing step: ' || failing_step, 'Errorcode: ' || error_code, 'ErrorMsg: ' || error_message) END AS ftrunner_snippet FROM parsed""",
)
def parse_snippets(spark, sf_dir):
    return parsed(spark, sf_dir).select("unit_id", "ftrunner_snippet")


# A step that says neither is unknown, except the last, which takes the run's verdict.
@query(
    "parse_steps",
    f"""WITH {LOGGED} SELECT unit_id, 1 AS step_no, 'PowerTest' AS name,
      CASE WHEN e % 9 < 3 THEN 'PASS' ELSE 'UNKNOWN' END AS result, CAST(e % 3000 AS DOUBLE) AS duration_s FROM parsed WHERE e % 9 <> 8
    UNION ALL SELECT unit_id, CASE WHEN e % 9 = 8 THEN 1 ELSE 2 END, 'Thermal Test', result, 7e0 FROM parsed""",
)
def parse_steps(spark, sf_dir):
    return parse.steps_table(parsed(spark, sf_dir))


@query(
    "scan_block",
    f"""WITH {LOGGED}, kv AS (SELECT run_folder, unnest(['SERIALNUMBER', 'PRODUCTCODE', 'OPID', 'STATIONID',
      CASE WHEN e % 2 = 0 THEN 'Host' ELSE 'HOST' END, 'TPDIR_NAME', 'TPDIR_VERSION']) AS key,
      unnest([serial_number, product_code, op_id, station_id, host, tp_name, tp_version]) AS value FROM parsed)
    SELECT run_folder, key, value FROM kv WHERE value IS NOT NULL""",
)
def scan_block(spark, sf_dir):
    return parse.block_entries(proxies.logs(spark, sf_dir), SCAN_HEADER)


@query(
    "done_block",
    f"""WITH {LOGGED}, kv AS (SELECT p.run_folder, unnest(['Result', 'EndTime', 'Errorcode', 'ErrorMsg']) AS key,
      unnest([CASE WHEN p.result = 'UNKNOWN' THEN 'ABORT' WHEN e % 2 = 0 THEN lower(p.result) ELSE p.result END,
        end_time_raw, p.error_code, p.error_message]) AS value FROM parsed p WHERE p.has_done_block)
    SELECT run_folder, key, value FROM kv WHERE value IS NOT NULL""",
)
def done_block(spark, sf_dir):
    return parse.block_entries(proxies.logs(spark, sf_dir), DONE_HEADER)


@query("parsed_daily_yield", f"""WITH {LOGGED} SELECT strftime(start_time, '%Y-%m-%d') AS date,
    count(*) FILTER (WHERE result = 'PASS') AS "pass", count(*) FILTER (WHERE result = 'FAIL') AS fail,
    CAST(round_even(CAST(count(*) FILTER (WHERE result = 'PASS') AS DOUBLE) / CAST(count(*) AS DOUBLE) * 100e0, 2) AS DOUBLE) AS yield
    FROM parsed WHERE result <> 'UNKNOWN' GROUP BY 1""")
def parsed_daily_yield(spark, sf_dir):
    from ..operators.yields import daily_yield

    return daily_yield(parsed(spark, sf_dir))


MASKED = redact_sql("t", *KEEP_SERIAL)


@query(
    "masked_snippets",
    f"""WITH {LOGGED}, s AS (SELECT unit_id, CASE WHEN result = 'FAIL' THEN concat_ws(chr(10), 'Result: FAIL',
    'Failing step: ' || failing_step, 'Errorcode: ' || error_code, 'ErrorMsg: ' || error_message) END AS t FROM parsed)
    SELECT unit_id, CASE WHEN length({MASKED}) > 2000 THEN left({MASKED}, 2000) || chr(10) || '...[truncated]' ELSE {MASKED} END AS snippet FROM s""",
)
def masked_snippets(spark, sf_dir):
    return parsed(spark, sf_dir).select(
        "unit_id", cap(redact(F.col("ftrunner_snippet"), keep_serial=True), 2000).alias("snippet")
    )


# The same logs parsed line by line in blocks of a few lines.
def large_logs(spark, sf_dir):
    logs = proxies.logs(spark, sf_dir)
    chosen = logs.select(F.col("run_folder").alias("file_key"), "run_folder", "file_name")
    return parse_lines.parse_lines(parse_lines.lines_of(logs, block_lines=9), chosen)


LINE_COLUMNS = list(dict.fromkeys(f"{IDENTITY}, {TIMES}, {VERDICT}".split(", ")))


@query("parse_large_logs", f"WITH {LOGGED} SELECT {', '.join(LINE_COLUMNS)} FROM parsed")
def parse_large_logs(spark, sf_dir):
    return large_logs(spark, sf_dir)[0].select(*LINE_COLUMNS)


@query(
    "parse_large_log_steps",
    f"""WITH {LOGGED} SELECT unit_id, CAST(1 AS BIGINT) AS step_no, 'PowerTest' AS name,
      CASE WHEN e % 9 < 3 THEN 'PASS' ELSE 'UNKNOWN' END AS result, CAST(e % 3000 AS DOUBLE) AS duration_s FROM parsed WHERE e % 9 <> 8
    UNION ALL SELECT unit_id, CASE WHEN e % 9 = 8 THEN 1 ELSE 2 END, 'Thermal Test', result, 7e0 FROM parsed""",
)
def parse_large_log_steps(spark, sf_dir):
    return large_logs(spark, sf_dir)[1].drop("run_folder")
