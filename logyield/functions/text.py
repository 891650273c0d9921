"""Small text expressions used across the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terminal colour codes (escape byte optional) and log-line prefix.
ANSI_CODE = r"\x1b?\[[0-9;]*m"
LOG_PREFIX = r"^\[\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}[^\]]*\]\s*"
# Fixed value: every character that counts as white space at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TRUNCATION_MARK = "\n…[truncated]"


def or_null(col: Column) -> Column:
    """'' as null."""
    return F.nullif(col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def strip_ansi(col: Column) -> Column:
    return F.regexp_replace(col, ANSI_CODE, "")


def strip_log_prefix(line: Column) -> Column:
    return F.regexp_replace(line, LOG_PREFIX, "")


def wall_clock(*parts: Column) -> Column:
    """Zone-less timestamp from year, month, day, hour, minute and second; null when invalid."""
    numbers = [p.try_cast("int") for p in parts]
    return F.when(numbers[-1] < 60, F.try_make_timestamp_ntz(*numbers))


def compact_timestamp(ts14: Column) -> Column:
    """``yyyyMMddHHmmss`` as a zone-less timestamp; anything else is null."""
    parts = [F.substring(ts14, at, size) for at, size in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 2), (13, 2))]
    return F.when(ts14.rlike(r"^\d{14}\z"), wall_clock(*parts))


def stamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as a zone-less timestamp."""
    parts = [F.substring(text, at, size) for at, size in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))]
    return wall_clock(*parts)


def run_id(folder: Column) -> Column:
    """Stable id of a run: leading 16 hex digits of the folder's sha1."""
    return F.substring(F.sha1(folder), 1, 16)


def cap(col: Column, budget: int) -> Column:
    """Text cut to ``budget`` characters with a visible mark; 0 means no limit."""
    if budget <= 0:
        return col
    return F.when(
        F.length(col) > budget, F.concat(rstrip(F.substring(col, 1, budget)), F.lit(TRUNCATION_MARK))
    ).otherwise(col)


def failure_snippet(result: Column, step: Column, code: Column, message: Column) -> Column:
    """Short failure summary; absent parts are left out, other results give null."""
    part = lambda label, c: F.concat(F.lit(label), or_null(c))
    return F.when(
        result == "FAIL",
        F.concat_ws(
            "\n",
            F.lit("Result: FAIL"),
            part("Failing step: ", step),
            part("Errorcode: ", code),
            part("ErrorMsg: ", message),
        ),
    )
