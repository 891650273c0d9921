"""Fixed values and column lists shared by the jobs."""

from __future__ import annotations

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"

# Classification names, in the order the engineer list shows them.
CLASS_ORDER = ("fail", "unknown", "retry_pass", "first_pass")

# Columns that put one unit's runs in time order; nulls come first.
TIME_ORDER = ("start_time", "end_time", "run_folder", "unit_id")

RUN_IDENTITY = (
    "unit_id",
    "serial_number",
    "product_code",
    "lot_id",
    "op_id",
    "station_id",
    "host",
    "start_time",
    "end_time",
    "duration_s",
    "result",
    "error_code",
    "error_message",
    "failing_step",
    "run_folder",
)

# Texts shown when a diagnosis field is blank.
NO_ROOT_CAUSE = "No root cause returned."
NO_SOLUTION = "No solution returned."
