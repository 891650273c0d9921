"""Tester log text → one run per log, with its steps.

The whole parse is a projection: every log becomes its run inside the task that
read it, without a shuffle or a Python worker. Only choosing one log per folder
(``one_log_per_folder``) regroups rows, and by then they are small.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kv import DONE_HEADER, SCAN_HEADER, kv_value, with_kv_entries
from ..functions.text import compact_timestamp, failure_snippet, or_null, run_id, stamp, strip, strip_ansi
from ..schema import FAIL, PASS, UNKNOWN

# Log line patterns. (?d) keeps '.' from stopping at anything but \n.
STEP_START = r"(?id)\*{3,}[^\S\n]*([^\n]+?)[^\S\n]*test start\.\*{3,}"
STEP_END = r"(?id)\*{3,}[^\S\n]*([^\n]+?)[^\S\n]*test end\.\*{3,}"
STEP_TIME = r"Test time\(hh\\mm\\ss\):\s*(\d{2}:\d{2}:\d{2})"
START_TIME = r"Test start time:\s*(\d{14})"
END_TIME = r"Test end time:\s*(\d{14})"
TOTAL_TIME = r"Total Test time\(s\):\s*([\d.]+)"
FIRST_STAMP = r"\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
LAST_STAMP = r"(?s)\A.*\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
ERR_LEVEL = r"\d{2}:\d{2}:\d{2}\s+ERR\]"
TEST_MODE = r"(?i)testmode\s*:\s*(\S+)"
LOT_ID = r"(?i)\blotid\s*=\s*([^;\s]+)"
LOT_ID_LOOSE = r"(?i)\bLotID\s*=\s*(\S+)"
# What every match of a pattern holds; a text without it is not searched. Lower case for (?i) patterns.
ERR_PART = "ERR]"
TEST_MODE_PART = "testmode"
LOT_PART = "lotid"
# The last stamp is looked for in so many last characters first, then in the whole text.
LAST_CHARS = 256
LOT_FOLDER = r"(?i)^(LOTAM2|NoLotId|ENG1|STC)_"

STEP_ARRAY = "array<struct<name:string,result:string,duration_s:double>>"

# Hints of a motherboard flow, in the text or as a step name.
PAN_HINTS = ("hst_et", "aguila", "mb_pan_test", "executiontool.exe", "hst_mix")
PAN_STEPS = ("mb_pan_test", "hst_et")

# What an error line without a verdict block is reported as.
IMPLICIT_CODE = "UNKNOWN"
IMPLICIT_MESSAGE = "FTRunner reported an error (see source log for detail)."

# Scan-block keys of the identity columns.
SCAN_KEYS = {
    "serial_number": "SERIALNUMBER",
    "product_code": "PRODUCTCODE",
    "op_id": "OPID",
    "station_id": "STATIONID",
    "tp_name": "TPDIR_NAME",
    "tp_version": "TPDIR_VERSION",
}


def unix_text(raw: Column) -> Column:
    """Log text with plain line ends and without colour codes."""
    ends = F.when(F.contains(raw, F.lit("\r")), F.regexp_replace(raw, "\r\n?", "\n")).otherwise(raw)
    return strip_ansi(ends)


def found(text: Column, pattern: str) -> Column:
    """First capture of the pattern, null without a match."""
    return or_null(F.regexp_extract(text, pattern, 1))


def last_stamp(text: Column) -> Column:
    return F.coalesce(found(F.right(text, F.lit(LAST_CHARS)), LAST_STAMP), found(text, LAST_STAMP))


def seconds(hms: Column) -> Column:
    part = F.split(hms, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def verdict_of(explicit: Column, said: Column, code: Column, message: Column, error_line: Column) -> dict[str, Column]:
    """Result and error fields from the done block, else from error-level lines."""
    told = F.upper(said)
    result = (
        F.when(explicit & told.isin(PASS, FAIL), told).when(explicit, UNKNOWN).when(error_line, FAIL).otherwise(PASS)
    )
    failed, implicit = result == FAIL, ~explicit
    return {
        "has_done_block": explicit,
        "result": result,
        "error_code": F.when(failed & implicit, IMPLICIT_CODE).when(failed, or_null(code)),
        "error_message": F.when(failed & implicit, IMPLICIT_MESSAGE).when(failed, or_null(message)),
    }


def verdict(entries: Column, text: Column) -> dict[str, Column]:
    said, code, message = (kv_value(entries, k) for k in ("Result", "Errorcode", "ErrorMsg"))
    return verdict_of(
        F.size(entries) > 0, said, code, message, F.contains(text, F.lit(ERR_PART)) & text.rlike(ERR_LEVEL)
    )


def with_step_zones(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the step blocks: from each start marker to the next, the last up to the done header.

    Every block is split at its end marker into the part before it, which tells
    the result, and the part after it; without a marker there is no second part.
    """
    marked = (
        df.withColumn("_names", F.regexp_extract_all(text, F.lit(STEP_START), 1))
        .withColumn("_parts", F.split(text, STEP_START, -1))
        .withColumn("_steps", F.size("_names"))
        .withColumn("_tail", F.element_at("_parts", -1))
    )
    done_earlier = F.exists(F.slice("_parts", 1, F.col("_steps")), lambda p: p.rlike(DONE_HEADER))
    cut = marked.withColumn("_tail", F.when(done_earlier, "").otherwise(F.split("_tail", DONE_HEADER, 2)[0]))
    blocks = F.concat(F.slice("_parts", 2, F.greatest(F.col("_steps") - 1, F.lit(0))), F.array("_tail"))
    paired = cut.withColumn(
        "_blocks",
        F.when(F.col("_steps") > 0, F.arrays_zip(F.col("_names").alias("name"), blocks.alias("block"))),
    ).withColumn(
        "_blocks",
        F.transform(
            "_blocks",
            lambda b: F.struct(
                strip(b["name"]).alias("name"), b["block"].alias("block"), F.split(b["block"], STEP_END, 2).alias("halves")
            ),
        ),
    )
    zones = F.transform(
        "_blocks",
        lambda b: F.struct(
            b["name"].alias("name"),
            F.lower(b["halves"][0]).alias("before"),
            F.coalesce(found(F.get(b["halves"], F.lit(1)), STEP_TIME), found(b["block"], STEP_TIME)).alias("spent"),
        ),
    )
    empty = F.array().cast("array<struct<name:string,before:string,spent:string>>")
    return paired.withColumn(into, F.coalesce(zones, empty)).drop("_names", "_parts", "_steps", "_tail", "_blocks")


def step_records(zones: Column, run_result: Column) -> Column:
    last = F.size(zones) - 1

    def record(z: Column, i: Column) -> Column:
        result = (
            F.when(F.contains(z["before"], F.lit("failed")), FAIL)
            .when(F.contains(z["before"], F.lit("passed")), PASS)
            .when(i == last, run_result)
            .otherwise(UNKNOWN)
        )
        return F.struct(
            z["name"].alias("name"),
            result.alias("result"),
            F.coalesce(seconds(z["spent"]), F.lit(0.0)).alias("duration_s"),
        )

    return F.transform(zones, record)


def trimmed_lot(stated: Column) -> Column:
    return or_null(F.regexp_replace(strip(stated), "[;,]+$", ""))


def lot_id(stated: Column, folder: Column) -> Column:
    """The lot named in the log, else the known prefix of the folder's name."""
    base = F.element_at(F.split(folder, "/"), -1)
    return F.when(stated.isNotNull(), trimmed_lot(stated)).otherwise(found(base, LOT_FOLDER))


def device_class(low: Column, steps: Column, mode: Column) -> Column:
    """Class told by the text in lower case, the steps' names and the test mode."""
    hinted = F.contains(low, F.lit(PAN_HINTS[0]))
    for hint in PAN_HINTS[1:]:
        hinted = hinted | F.contains(low, F.lit(hint))
    pan_step = F.exists(steps, lambda s: F.lower(s["name"]).isin(*PAN_STEPS))
    addin = F.coalesce(F.upper(mode) == "TESTAPP", F.lit(False)) | (F.size(steps) > 0)
    return F.when(hinted | pan_step, "pan").when(addin, "aic").otherwise("unknown")


def run_columns(fields: DataFrame) -> DataFrame:
    """The run table's columns from the parsed fields."""
    clock = F.timestamp_diff("MILLISECOND", F.col("start_time"), F.col("end_time")) / 1000.0
    return fields.select(
        run_id(F.col("run_folder")).alias("unit_id"),
        "serial_number",
        "product_code",
        "lot_id",
        "op_id",
        "station_id",
        "host",
        "start_time",
        "end_time",
        "end_time_raw",
        F.coalesce(clock, F.col("step_duration_s")).alias("duration_s"),
        F.when(clock.isNotNull(), "clock").otherwise("steps").alias("duration_basis"),
        "step_duration_s",
        "total_test_time_s",
        "result",
        "has_done_block",
        "error_code",
        "error_message",
        "failing_step",
        "steps",
        F.array("file_name").alias("source_files"),
        "run_folder",
        "tp_name",
        "tp_version",
        "test_mode",
        "device_class",
        failure_snippet(*[F.col(c) for c in ("result", "failing_step", "error_code", "error_message")]).alias(
            "ftrunner_snippet"
        ),
    )


class Steps:
    """Column steps, noted once and taken on any DataFrame with these columns.

    A stream parses many micro-batches: to build thousands of expressions takes longer than to parse a few hundred logs.
    """

    def __init__(self):
        self.taken = []

    def __getattr__(self, method: str):
        def note(*args) -> Steps:
            self.taken.append((method, args))
            return self

        return note

    def on(self, df: DataFrame) -> DataFrame:
        return reduce(lambda rows, step: getattr(rows, step[0])(*step[1]), self.taken, df)


def parse_logs(logs: DataFrame) -> DataFrame:
    """``logs`` (run_folder, file_name, text) → run columns with a nested step array."""
    return parse_steps(logs.sparkSession.sparkContext.applicationId).on(logs)


@lru_cache(maxsize=1)
def parse_steps(application: str) -> Steps:
    """The parse as column steps; expressions belong to one application."""
    logs = Steps()
    t, low = F.col("_text"), F.col("_low")
    # One step per withColumns: each costly column is computed once and then referred to.
    lines = logs.withColumn("_text", unix_text(F.col("text"))).drop("text")
    blocks = with_kv_entries(with_kv_entries(lines, "_text", SCAN_HEADER, "_scan"), "_text", DONE_HEADER, "_done")
    judged = with_step_zones(blocks, "_text", "_zones").withColumns({**verdict(F.col("_done"), t), "_low": F.lower(t)})
    stepped = judged.withColumn("steps", step_records(F.col("_zones"), F.col("result")))
    done_end = or_null(kv_value(F.col("_done"), "EndTime"))
    failing = F.get(F.filter("steps", lambda s: s["result"] == FAIL), F.lit(0))["name"]
    fields = stepped.withColumns(
        {
            **{c: or_null(kv_value(F.col("_scan"), k)) for c, k in SCAN_KEYS.items()},
            "host": F.coalesce(
                or_null(kv_value(F.col("_scan"), "Host")), or_null(kv_value(F.col("_scan"), "HOST"))
            ),
            "failing_step": or_null(failing),
            "test_mode": F.when(F.contains(low, F.lit(TEST_MODE_PART)), found(t, TEST_MODE)),
            "_lot": F.when(
                F.contains(low, F.lit(LOT_PART)), F.coalesce(found(t, LOT_ID), found(t, LOT_ID_LOOSE))
            ),
            "total_test_time_s": found(t, TOTAL_TIME).try_cast("double"),
            "_start": found(t, START_TIME),
            "_end": found(t, END_TIME),
            "_first": found(t, FIRST_STAMP),
            "_last": last_stamp(t),
            "end_time_raw": done_end,
            "step_duration_s": F.round(
                F.aggregate("steps", F.lit(0.0), lambda acc, s: acc + s["duration_s"]), 3
            ),
        }
    )
    timed = fields.withColumns(
        {
            "start_time": F.coalesce(compact_timestamp(F.col("_start")), stamp(F.col("_first"))),
            "lot_id": lot_id(F.col("_lot"), F.col("run_folder")),
            "end_time": F.when(F.col("end_time_raw").isNotNull(), compact_timestamp(F.col("end_time_raw"))).otherwise(
                F.coalesce(compact_timestamp(F.col("_end")), stamp(F.col("_last")))
            ),
            "device_class": device_class(low, F.col("steps"), F.col("test_mode")),
        }
    )
    return run_columns(timed)


def one_log_per_folder(runs: DataFrame) -> DataFrame:
    """Keep the run of the first log by name where a folder holds several.

    Ranked, not gathered in one struct: columns that nobody reads are neither parsed nor moved. Of logs with equal
    names the last in reading order is kept.
    """
    by_name = Window.partitionBy("run_folder").orderBy(F.col("source_files")[0].asc_nulls_last(), F.col("_read").desc())
    ranked = runs.withColumn("_read", F.monotonically_increasing_id()).withColumn("_rank", F.row_number().over(by_name))
    return ranked.filter(F.col("_rank") == 1).drop("_rank", "_read")


def steps_table(runs: DataFrame) -> DataFrame:
    """One row per step, numbered from 1."""
    # The outer form, filtered afterwards, keeps the planner from evaluating the
    # array a second time in a size check pushed below the parse.
    return (
        runs.select("unit_id", F.posexplode_outer("steps").alias("_pos", "s"))
        .filter(F.col("_pos").isNotNull())
        .select("unit_id", (F.col("_pos") + 1).alias("step_no"), "s.name", "s.result", "s.duration_s")
    )


def block_entries(logs: DataFrame, header: str) -> DataFrame:
    """KEY=value pairs of the first block under a header; the last duplicate wins."""
    lines = logs.select("run_folder", unix_text(F.col("text")).alias("_text"))
    entries = with_kv_entries(lines, "_text", header, "_kv")
    entries = entries.select("run_folder", F.posexplode_outer("_kv").alias("pos", "e")).filter(F.col("pos").isNotNull())
    return (
        entries.groupBy("run_folder", F.col("e.key").alias("key"))
        .agg(F.max_by(F.col("e.value"), F.col("pos")).alias("value"))
    )
