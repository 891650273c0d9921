"""Bounded part of a debug log around the failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .redaction import redact
from .text import or_null, strip, strip_ansi

# Fallback markers and default size in characters.
GENERIC_MARKERS = ("traceback", "exception", "result : failed", "error", "fail")
EXCERPT_BUDGET = 6000


def find(text: Column, needle: Column) -> Column:
    """0-based position of the first hit; null when absent or nothing to look for."""
    wanted = or_null(needle)
    return F.when(F.contains(text, wanted), F.instr(text, wanted) - 1)


def rfind(text: Column, marker: str) -> Column:
    """0-based position of the last hit; negative when there is none."""
    after = F.substring_index(text, marker, -1)
    return F.length(text) - F.length(after) - F.lit(len(marker))


def anchor(text: Column, needles: list[Column]) -> Column:
    """First hit of the first needle present, else the last generic marker, else null."""
    low = F.lower(text)
    last = F.greatest(*[rfind(low, m) for m in GENERIC_MARKERS])
    return F.coalesce(*[find(text, n) for n in needles], F.when(last >= 0, last))


def window_at(text: Column, position: Column, budget: int) -> Column:
    """``budget`` characters centred on the position, or the tail without one."""
    half = budget // 2
    start = F.greatest(F.lit(0), position - half)
    end = F.least(F.length(text), position + half)
    return F.when(position.isNull(), F.right(text, F.lit(budget))).otherwise(
        F.substring(text, start + 1, end - start)
    )


def with_debug_excerpt(
    df: DataFrame,
    raw: str,
    code: Column,
    message: Column,
    step: Column,
    budget: int = EXCERPT_BUDGET,
    into: str = "debug_excerpt",
) -> DataFrame:
    """Add the masked excerpt (serial kept), null when the log is blank.

    The cleaned text and the anchor are columns of their own, so each is
    computed once however often the later steps refer to it.
    """
    return (
        df.withColumn("_text", strip_ansi(F.col(raw)))
        .withColumn("_at", anchor(F.col("_text"), [code, message, step]))
        .withColumn("_cut", strip(window_at(F.col("_text"), F.col("_at"), budget)))
        .withColumn(into, or_null(redact(F.col("_cut"), keep_serial=True)))
        .drop("_text", "_at", "_cut")
    )
