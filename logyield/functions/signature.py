"""Failure signature and the text handed to a diagnosis provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .redaction import redact
from .text import or_null, strip


def normalized_message(message: Column) -> Column:
    """Lower case, digit runs as '#', single blanks; null gives ''."""
    text = F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"(?U)\d+", "#")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def signature(code: Column, message: Column) -> Column:
    basis = F.concat_ws("|", F.coalesce(or_null(code), F.lit("FAIL")), normalized_message(message))
    return F.substring(F.sha1(basis), 1, 16)


def context_source() -> Column:
    return (
        F.when(or_null(F.col("debug_excerpt")).isNotNull(), "debug_excerpt")
        .when(or_null(F.col("ftrunner_snippet")).isNotNull(), "ftrunner_snippet")
        .otherwise("error_message")
    )


def context() -> Column:
    return F.coalesce(
        or_null(F.col("debug_excerpt")),
        or_null(F.col("ftrunner_snippet")),
        F.col("error_message"),
        F.lit(""),
    )


def redacted_context() -> Column:
    """Context without any serial number."""
    return redact(context())
