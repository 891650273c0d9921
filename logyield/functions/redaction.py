"""Masking of credentials, hosts, addresses and serial numbers.

The rules are chained ``regexp_replace`` calls in a fixed order. ``(?U)`` makes
``\\b \\d \\s \\S`` Unicode-aware, so a keyword glued to an accented letter is not
a match. What a rule begins with is looked for ahead of the word boundary, which costs
far more at every character; it takes no match away.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (rule, pattern, replacement), applied in this order.
RULES = (
    ("user_switch", r"(?iU)(-u\s+)\S+", "$1[REDACTED_USER]"),
    ("password_switch", r"(?iU)(-p\s+)\S+", "$1[REDACTED_PW]"),
    (
        "secret_pair",
        r"(?iU)(?=[psta])\b(password|passwd|pwd|secret|token|apikey|api_key)\s*[=:]\s*\S+",
        "$1=[REDACTED]",
    ),
    ("user_pair", r"(?iU)(?=u)\b(user|username|userid|uid)\s*[=:]\s*\S+", "$1=[REDACTED_USER]"),
    ("host_pair", r"(?iU)(?=[ht])\b(host|hostname|testserver)\s*[=:]\s*\S+", "$1=[REDACTED_HOST]"),
    ("unc_host", r"\\\\[A-Za-z0-9._-]+", r"\\\\[REDACTED_HOST]"),
    ("mac", r"(?U)(?=[0-9A-Fa-f]{2}[:-])\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[REDACTED_MAC]"),
    ("ipv4", r"(?U)(?=\d)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
)
# Serial rules, left out when the serial is kept.
SERIAL_RULES = (
    ("serial_pair", r"(?iU)(?=[sc])\b(serialnumber|child_sn|serial)\s*[=:]\s*\S+", "$1=[REDACTED_SN]"),
    ("serial_code", r"(?U)(?=RM)\bRM[A-Z]{1,2}\d{6,}\b", "[REDACTED_SN]"),
)

# A masked pair or switch, which the keyword rules would match again.
MASKED = r"(?i)(?:-[up]\s+|\w+=)\[REDACTED[A-Z_]*\]"


def rules(keep_serial: bool = False) -> tuple[tuple[str, str, str], ...]:
    return RULES if keep_serial else RULES + SERIAL_RULES


def apply_rule(col: Column, name: str) -> Column:
    pattern, mask = next((p, m) for n, p, m in RULES + SERIAL_RULES if n == name)
    return F.regexp_replace(col, pattern, mask)


def redact(col: Column, keep_serial: bool = False) -> Column:
    """The masked text; null becomes ''."""
    out = F.coalesce(col, F.lit(""))
    for _, pattern, mask in rules(keep_serial):
        out = F.regexp_replace(out, pattern, mask)
    return out


def redact_columns(df: DataFrame, columns: Iterable[str], keep_serial: bool = False) -> DataFrame:
    return df.withColumns({c: redact(F.col(c), keep_serial) for c in columns})


def audit(df: DataFrame, text: str, keep_serial: bool = False) -> DataFrame:
    """Unmasked hits per rule left in ``text``; every count should be 0."""
    bare = df.select(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), MASKED, " ").alias("t"))
    names = [n for n, _, _ in rules(keep_serial)]
    sums = bare.agg(
        *[
            F.coalesce(F.sum(F.regexp_count("t", F.lit(p))), F.lit(0)).alias(n)
            for n, p, _ in rules(keep_serial)
        ]
    )
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("hits")) for n in names])).alias("r")
    ).select("r.rule", "r.hits")
