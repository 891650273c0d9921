"""KEY=value blocks that follow a header line in a tester log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOG_PREFIX, strip

# Block headers, the line pattern and the line breaks that end a line.
SCAN_HEADER = r"(?i)scan file content:"
DONE_HEADER = r"(?i)done file content:"
KV_LINE = r"(?d)^([A-Za-z_]+)\s*=\s*(.*)$"
LINE_BREAKS = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Lines looked at first. A block that has not ended by then is cut from the
# whole rest of the text instead, so no block length is excluded.
NEAR_LINES = 64


def _clean(lines: Column) -> Column:
    bare = lambda x: F.when(x.startswith("["), F.regexp_replace(x, LOG_PREFIX, "")).otherwise(x)
    return F.transform(lines, lambda x: strip(bare(x)))


def _first(lines: Column, test) -> Column:
    """1-based position of the first line that passes, 0 when none does."""
    return F.coalesce(F.array_position(F.transform(lines, test), True), F.lit(0)).cast("int")


def _from(lines: Column, begin: Column) -> Column:
    return F.when(begin > 0, F.slice(lines, begin, F.size(lines))).otherwise(F.array().cast("array<string>"))


def with_kv_entries(df: DataFrame, text: str, header: str, into: str) -> DataFrame:
    """Add the (key, value) pairs of the first block under ``header``, in order.

    Each stage is its own column: array functions evaluate their arguments
    again wherever they are written, but read a finished column for free.
    """
    rest, near, lines, begin, near_end, cut_off, tail, stop, kept = (
        f"_{into}_{s}" for s in ("rest", "near", "lines", "begin", "end", "cut", "tail", "stop", "kept")
    )
    has_text = lambda x: x != ""
    has_equals = lambda x: F.contains(x, F.lit("="))
    end_of_block = lambda x: ~x.rlike(KV_LINE)
    staged = (
        df.withColumn(rest, F.regexp_extract(text, f"(?s){header}(.*)", 1))
        .withColumn(near, F.split(rest, LINE_BREAKS, NEAR_LINES))
        # The last of NEAR_LINES pieces still holds unsplit text: leave it out.
        .withColumn(lines, F.slice(near, 1, NEAR_LINES - 1))
        # Only lines up to the first without a '=' behind one that has it are cleaned: no block goes on beyond.
        .withColumn(begin, _first(F.col(lines), has_equals))
        .withColumn(
            near_end, _first(F.slice(lines, F.col(begin) + 1, F.size(lines)), lambda x: ~has_equals(x))
        )
        .withColumn(cut_off, (F.col(begin) > 0) & (F.col(near_end) > 0))
        .withColumn(
            lines,
            _clean(F.when(F.col(cut_off), F.slice(lines, 1, F.col(begin) + F.col(near_end))).otherwise(F.col(lines))),
        )
        .withColumn(tail, _from(F.col(lines), _first(F.col(lines), has_text)))
        .withColumn(stop, _first(F.col(tail), end_of_block))
    )
    ended = (F.col(stop) > 0) | (~F.col(cut_off) & (F.size(near) < NEAR_LINES))
    cut = (
        staged.withColumn(lines, F.when(~ended, _clean(F.split(rest, LINE_BREAKS))))
        .withColumn(kept, F.when(ended, F.col(tail)).otherwise(_from(F.col(lines), _first(F.col(lines), has_text))))
        .withColumn(stop, F.when(ended, F.col(stop)).otherwise(_first(F.col(kept), end_of_block)))
        .withColumn(kept, F.when(F.col(stop) > 0, F.slice(kept, 1, F.col(stop) - 1)).otherwise(F.col(kept)))
    )
    pair = lambda x: F.struct(
        F.regexp_extract(x, KV_LINE, 1).alias("key"), strip(F.regexp_extract(x, KV_LINE, 2)).alias("value")
    )
    return cut.withColumn(into, F.transform(kept, pair)).drop(rest, near, lines, begin, near_end, cut_off, tail, stop, kept)


def kv_value(entries: Column, key: str) -> Column:
    """Value of a key; the last duplicate wins, absent gives null."""
    hits = F.filter(entries, lambda e: e["key"] == key)
    return F.try_element_at(hits, F.lit(-1))["value"]
