"""Redaction, excerpts and line tools on literal texts."""

import pytest
from pyspark.sql import functions as F

from logyield.functions import excerpt, lines, redaction, signature, text


def column(spark, values, expr, name="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col(name))).collect()]


MASKED = {
    "psexec -u sysc -p tr@nsf3r": "psexec -u [REDACTED_USER] -p [REDACTED_PW]",
    "Password : abc rest": "Password=[REDACTED] rest",
    "api_key=1 apikey:2": "api_key=[REDACTED] apikey=[REDACTED]",
    "UID=7": "UID=[REDACTED_USER]",
    "hostname=h1.lab": "hostname=[REDACTED_HOST]",
    "copy \\\\srv-1\\share": "copy \\\\[REDACTED_HOST]\\share",
    "00:1A:2b:3C:4d:5E": "[REDACTED_MAC]",
    "at 10.250.0.1 now": "at [REDACTED_IP] now",
    "999.999.999.999": "[REDACTED_IP]",
    "SerialNumber=SN1": "SerialNumber=[REDACTED_SN]",
    "RMA1234567 RM12345 rma1234567": "[REDACTED_SN] RM12345 rma1234567",
    "étoken=x token=y": "étoken=x token=[REDACTED]",
    "mytoken=x": "mytoken=x",
    "": "",
}


def test_redaction(spark):
    assert column(spark, list(MASKED), redaction.redact) == list(MASKED.values())
    assert column(spark, [None], redaction.redact) == [""]


def test_redaction_is_idempotent_and_leaves_nothing(spark):
    joined = [" ".join(MASKED), *MASKED]
    once = column(spark, joined, redaction.redact)
    assert column(spark, once, redaction.redact) == once
    df = spark.createDataFrame([(t,) for t in once], "t string")
    assert {r.hits for r in redaction.audit(df, "t").collect()} == {0}


def test_keep_serial(spark):
    keep = lambda c: redaction.redact(c, keep_serial=True)
    assert column(spark, ["serial=SN1 host=x"], keep) == ["serial=SN1 host=[REDACTED_HOST]"]


def cut(spark, raw, code=None, message=None, step=None, budget=excerpt.EXCERPT_BUDGET):
    df = spark.createDataFrame([(raw, code, message, step)], "raw string, code string, message string, step string")
    out = excerpt.with_debug_excerpt(df, "raw", F.col("code"), F.col("message"), F.col("step"), budget)
    return out.first().debug_excerpt


def test_excerpt_anchors(spark):
    noise = "noise\n" * 100
    assert "E001" in cut(spark, noise + "E001 Voltage fault\n" + noise, code="E001", budget=40)
    assert cut(spark, "x" * 50 + "E001" + "y" * 50, code="E001", budget=20) == "x" * 10 + "E001" + "y" * 6
    assert "Temperature" in cut(spark, noise + "Temperature high" + noise, code="none", message="Temperature", budget=60)
    assert "Thermal" in cut(spark, noise + "Thermal stop" + noise, code="", step="Thermal", budget=60)
    both = "FAIL early " + "." * 100 + " late Error tail"
    assert cut(spark, both, budget=20) == ("." * 4 + " late Error tail")[:20].strip()


def test_excerpt_limits(spark):
    assert cut(spark, "") is None and cut(spark, "  \n ") is None and cut(spark, None) is None
    assert cut(spark, "A" * 10_000, budget=500) == "A" * 500
    assert cut(spark, "Connecting with -u sysc -p tr@nsf3r\nVoltage fault\n", message="Voltage fault") == (
        "Connecting with -u [REDACTED_USER] -p [REDACTED_PW]\nVoltage fault"
    )
    assert cut(spark, "İİİ fail x", budget=4) is not None


def brute_excerpt(raw, needles, budget):
    hits = [raw.find(n) for n in needles if n and n in raw]
    at = hits[0] if hits else max(raw.lower().rfind(m) for m in excerpt.GENERIC_MARKERS)
    if at < 0:
        return raw[-budget:].strip() or None
    return raw[max(0, at - budget // 2) : min(len(raw), at + budget // 2)].strip() or None


@pytest.mark.parametrize("seed", range(3))
def test_excerpt_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    words = ["error", "FAIL", "x", "é", " ", "\n", "Exception", "result : failed", "E7", "abc"]
    rows = []
    for i in range(200):
        raw = "".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40)))
        rows.append((i, raw, rnd.choice([None, "", "E7", "zz"]), rnd.choice([None, "abc"]), None))
    df = spark.createDataFrame(rows, "i int, raw string, code string, message string, step string")
    out = excerpt.with_debug_excerpt(df, "raw", F.col("code"), F.col("message"), F.col("step"), 21)
    got = {r.i: r.debug_excerpt for r in out.collect()}
    want = {i: brute_excerpt(raw, (c, m, s), 21) if raw.strip() else None for i, raw, c, m, s in rows}
    assert got == want


def test_cap_and_strip(spark):
    assert column(spark, ["abc", "ab  cd", None], lambda c: text.cap(c, 3)) == ["abc", "ab\n…[truncated]", None]
    assert column(spark, ["x" * 9], lambda c: text.cap(c, 0)) == ["x" * 9]
    assert column(spark, ["\u00a0\x1c a b\t\n"], text.strip) == ["a b"]
    assert column(spark, ["20251128090120", "2025", "20251328090120"], text.compact_timestamp)[1:] == [None, None]


def test_lines(spark):
    df = spark.createDataFrame([(1, "a ERR b\r\nWarning: x\nINFOX info\nERRATA\n"), (2, None), (3, "")], "id int, t string")
    rows = lines.explode_lines(df, "t", "id").select("line_no", lines.severity(F.col("line")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(1, "error"), (2, "warn"), (3, "info"), (4, "none"), (5, "none")]
    assert [(r.line_no, r.line) for r in lines.search(df, "t", "err", "id").collect()] == [(1, "a ERR b"), (4, "ERRATA")]
    assert [tuple(r) for r in lines.hit_counts(df, "t", "err", "id").orderBy("id").collect()] == [(1, 2, 5), (2, 0, 0), (3, 0, 0)]


@pytest.mark.parametrize("needle", ["aa", "A.", "b", "$"])
def test_match_spans_brute_force(spark, needle):
    samples = ["aaaa", "xaaxAA", "a.b$A.", "", "bbb", "$"]
    spans = column(spark, samples, lambda c: lines.match_spans(c, needle))
    for line, got in zip(samples, spans):
        want, at = [], line.lower().find(needle.lower())
        while at >= 0:
            want.append((at, at + len(needle)))
            at = line.lower().find(needle.lower(), at + len(needle))
        assert [tuple(s) for s in got] == want, (line, needle)


def test_signature(spark):
    df = spark.createDataFrame(
        [("E001", "Retry count 3 exceeded"), ("E001", "retry  COUNT 7 exceeded "), ("E002", "Retry count 3 exceeded"),
         ("E001", "other"), (None, None), ("", "")],
        "code string, message string",
    )
    s = [r[0] for r in df.select(signature.signature(F.col("code"), F.col("message"))).collect()]
    assert s[0] == s[1] and len(set(s)) == 4 and s[4] == s[5] and all(len(x) == 16 for x in s)


def test_many_spans_on_one_line(spark):
    """200 000 hits on a line: running sums by blocks, not one array that grows hit by hit."""
    import time

    line = "Err x" * 200_000
    df = spark.createDataFrame([(line,), ("",), (None,), ("no hit",), ("err",)], "line string")
    began = time.time()
    spans = [r.s for r in df.select(lines.match_spans(F.col("line"), "ERR").alias("s")).collect()]
    assert [(s.start, s.end) for s in spans[0]] == [(5 * i, 5 * i + 3) for i in range(200_000)]
    assert spans[1:4] == [[], None, []] and [(s.start, s.end) for s in spans[4]] == [(0, 3)]
    assert time.time() - began < 60
