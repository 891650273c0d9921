"""Line search, severity and match positions in log text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity keywords, most severe first.
SEVERITY = (
    ("error", ("CRITICAL", "FAILED", "FAIL", "ERROR", "ERR")),
    ("warn", ("WARNING", "WARN")),
    ("info", ("INFO",)),
)
LINE_BREAK = r"\r?\n"


def split_lines(text: Column) -> Column:
    """Lines of the text; null or '' has none."""
    return F.when(F.length(text) > 0, F.split(text, LINE_BREAK)).otherwise(F.array().cast("array<string>"))


def explode_lines(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per line with its 1-based number."""
    # Outer and filtered: a plain explode would split the text once more to test its size.
    return (
        df.select(*keep, F.posexplode_outer(split_lines(F.col(text))).alias("_pos", "line"))
        .filter(F.col("_pos").isNotNull())
        .select(*keep, (F.col("_pos") + 1).alias("line_no"), "line")
    )


def has(line: Column, needle: str) -> Column:
    return F.contains(F.lower(line), F.lit(needle.lower()))


def search(df: DataFrame, text: str, needle: str, *keep: str) -> DataFrame:
    """Lines holding the needle in any case, with their original numbers."""
    return explode_lines(df, text, *keep).filter(has(F.col("line"), needle))


def hit_counts(df: DataFrame, text: str, needle: str, *keep: str) -> DataFrame:
    """"k of n lines" per text."""
    lines = split_lines(F.col(text))
    return df.select(
        *keep,
        F.size(F.filter(lines, lambda x: has(x, needle))).alias("matching"),
        F.size(lines).alias("lines"),
    )


def severity(line: Column) -> Column:
    """Most severe keyword class of the line, 'none' without one."""
    out = F.lit("none")
    for level, words in reversed(SEVERITY):
        pattern = rf"(?i)(?<![A-Za-z0-9_])({'|'.join(words)})(?![A-Za-z0-9_])"
        out = F.when(line.rlike(pattern), level).otherwise(out)
    return out


def match_count(line: Column, needle: str) -> Column:
    return F.size(_pieces(line, needle)) - 1


def _pieces(line: Column, needle: str) -> Column:
    quoted = "".join(c if c.isalnum() else re.escape(c) for c in needle.lower())
    return F.split(F.lower(line), quoted, -1)


# Entries of a block of running sums: an array that grows entry by entry is copied each time, so it stays short.
SUM_BLOCK = 512


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each entry of an array of ints: inside blocks, then over the blocks' totals."""
    none = F.array().cast("array<int>")

    def added(entries: Column) -> Column:
        first = F.struct(F.lit(0).alias("sum"), none.alias("out"))
        step = lambda s, x: F.struct(
            (s["sum"] + x).alias("sum"), F.concat(s["out"], F.array(s["sum"] + x)).alias("out")
        )
        return F.aggregate(entries, first, step, lambda s: s["out"])

    # Arrays bound by transform are made once; written twice they would be made for every use.
    def over(values: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(SUM_BLOCK))
        blocks = F.transform(begins, lambda at: added(F.slice(values, at, SUM_BLOCK)))
        return F.transform(F.array(blocks), joined)[0]

    def joined(blocks: Column) -> Column:
        totals = added(F.transform(blocks, lambda b: F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(0))))
        before = F.concat(F.array(F.lit(0)), totals)
        return F.flatten(
            F.transform(F.arrays_zip(blocks.alias("block"), F.slice(before, 1, F.size(blocks)).alias("before")),
                        lambda z: F.transform(z["block"], lambda x: x + z["before"]))
        )

    return F.transform(F.array(numbers), over)[0]


def match_spans(line: Column, needle: str) -> Column:
    """Array of (start, end) of all non-overlapping hits, 0-based, end exclusive."""
    width = len(needle)
    # Each piece but the last ends where a hit begins.
    steps = F.transform(
        F.array(_pieces(line, needle)),
        lambda pieces: F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.length(x) + width),
    )[0]
    return F.transform(running_sums(steps), lambda end: F.struct((end - width).alias("start"), end.alias("end")))
