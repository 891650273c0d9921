"""Text expressions over ``documents`` and the failing proxy runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import excerpt, lines, redaction, signature, text
from ..sources import proxies
from .registry import query
from .sql import FAILURES, KEEP_SERIAL, REDACTION, RUNS, SNIPPET, TEXTS, redact_sql, strip_sql

NEEDLE = "tion"
ANSI_SQL = "regexp_replace(text, '\\x1b?\\[[0-9;]*m', '', 'g')"

for _name in REDACTION:
    query(f"mask_{_name}", f"WITH {TEXTS} SELECT doc_id, {redact_sql('text', _name)} AS text FROM texts")(
        lambda spark, sf_dir, rule=_name: proxies.texts(spark, sf_dir).select(
            "doc_id", redaction.apply_rule(F.col("text"), rule).alias("text")
        )
    )


@query("redact_text", f"WITH {TEXTS} SELECT doc_id, {redact_sql('text')} AS text FROM texts")
def redact_text(spark, sf_dir):
    return redaction.redact_columns(proxies.texts(spark, sf_dir), ["text"])


@query("redact_keep_serial", f"WITH {TEXTS} SELECT doc_id, {redact_sql('text', *KEEP_SERIAL)} AS text FROM texts")
def redact_keep_serial(spark, sf_dir):
    return redaction.redact_columns(proxies.texts(spark, sf_dir), ["text"], keep_serial=True)


@query(
    "redact_columns",
    f"""WITH {FAILURES} SELECT unit_id, {redact_sql('error_message')} AS error_message,
    {redact_sql('debug_excerpt')} AS debug_excerpt FROM failures""",
)
def redact_columns(spark, sf_dir):
    df = proxies.failures(spark, sf_dir).select("unit_id", "error_message", "debug_excerpt")
    return redaction.redact_columns(df, ["error_message", "debug_excerpt"])


MASKED_HITS = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(sum(length(regexp_extract_all(t, '{p}'))) AS BIGINT) AS hits FROM masked"
    for n, (p, _) in REDACTION.items()
)


@query(
    "redaction_audit",
    f"""WITH {TEXTS}, masked AS (SELECT regexp_replace({redact_sql('text')}, '{redaction.MASKED}', ' ', 'g') AS t FROM texts)
    {MASKED_HITS}""",
)
def redaction_audit(spark, sf_dir):
    return redaction.audit(redact_text(spark, sf_dir), "text")


RAW_HITS = " UNION ALL ".join(
    f"SELECT '{n}' AS rule, CAST(sum(length(regexp_extract_all(text, '{p}'))) AS BIGINT) AS hits FROM texts"
    for n, (p, _) in REDACTION.items()
)


@query("redaction_hits", f"WITH {TEXTS} {RAW_HITS}")
def redaction_hits(spark, sf_dir):
    return redaction.audit(proxies.texts(spark, sf_dir), "text")


@query("strip_ansi", f"WITH {TEXTS} SELECT doc_id, {ANSI_SQL} AS text FROM texts")
def strip_ansi(spark, sf_dir):
    return proxies.texts(spark, sf_dir).select("doc_id", text.strip_ansi(F.col("text")).alias("text"))


@query("strip_log_prefix", f"WITH {RUNS} SELECT unit_id, coalesce(run_folder, '') AS line FROM runs")
def strip_log_prefix(spark, sf_dir):
    stamped = F.concat(F.lit("["), F.date_format(F.coalesce("start_time", F.lit("2024-01-01").cast("timestamp_ntz")),
                       "yyyy-MM-dd HH:mm:ss"), F.lit(" INF] "), F.col("run_folder"))
    return proxies.runs(spark, sf_dir).select("unit_id", text.strip_log_prefix(stamped).alias("line"))


@query(
    "compact_timestamp",
    f"""WITH {RUNS} SELECT unit_id, CASE WHEN CAST(unit_id AS BIGINT) % 9 <> 0
    THEN CAST(date_trunc('second', start_time) AS TIMESTAMP) END AS parsed FROM runs""",
)
def compact_timestamp(spark, sf_dir):
    e = F.col("unit_id").cast("long")
    good = F.date_format("start_time", "yyyyMMddHHmmss")
    raw = F.when(e % 18 == 0, "20249901000000").when(e % 9 == 0, F.substring(good, 1, 12)).otherwise(good)
    return proxies.runs(spark, sf_dir).select("unit_id", text.compact_timestamp(raw).alias("parsed"))


@query("run_id", "SELECT page_id, left(sha1(url), 16) AS run_id FROM pages")
def run_id(spark, sf_dir):
    return proxies.table(spark, sf_dir, "pages").select("page_id", text.run_id(F.col("url")).alias("run_id"))


@query(
    "failure_snippet",
    f"WITH {RUNS} SELECT unit_id, CASE WHEN result = 'FAIL' THEN {SNIPPET} END AS snippet FROM runs",
)
def failure_snippet(spark, sf_dir):
    return proxies.runs(spark, sf_dir).select(
        "unit_id",
        text.failure_snippet(*[F.col(c) for c in ("result", "failing_step", "error_code", "error_message")]).alias(
            "snippet"
        ),
    )


@query(
    "cap_text",
    """SELECT doc_id, CASE WHEN length(text) > 2000 THEN regexp_replace(left(text, 2000), '\\s+$', '') || chr(10)
    || '…[truncated]' ELSE text END AS text FROM documents""",
)
def cap_text(spark, sf_dir):
    return proxies.table(spark, sf_dir, "documents").select("doc_id", text.cap(F.col("text"), 2000).alias("text"))


# Anchors: a code that is present, one that is not, a step only, or nothing.
def _last(marker: str) -> str:
    return f"length(low) - length(list_last(string_split(low, '{marker}'))) - {len(marker)}"


def _find(needle: str) -> str:
    return f"CASE WHEN coalesce({needle}, '') <> '' AND contains(t, {needle}) THEN strpos(t, {needle}) - 1 END"


EXCERPT = f"""WITH {TEXTS}, a AS (SELECT doc_id, {ANSI_SQL} AS t,
    CASE WHEN doc_id % 4 = 0 THEN 'sysc' || doc_id WHEN doc_id % 4 = 1 THEN 'E-none' END AS code,
    CASE WHEN doc_id % 4 = 1 THEN 'at 10.250' ELSE '' END AS message,
    CASE WHEN doc_id % 4 = 2 THEN 'tion' END AS step FROM texts),
b AS (SELECT *, lower(t) AS low FROM a),
c AS (SELECT *, greatest({', '.join(_last(m) for m in excerpt.GENERIC_MARKERS)}) AS last FROM b),
p AS (SELECT *, coalesce({_find('code')}, {_find('message')}, {_find('step')}, CASE WHEN last >= 0 THEN last END) AS pos FROM c),
w AS (SELECT *, CASE WHEN pos IS NULL THEN right(t, 600) ELSE substring(t, CAST(greatest(0, pos - 300) + 1 AS BIGINT),
    CAST(least(length(t), pos + 300) - greatest(0, pos - 300) AS BIGINT)) END AS cut FROM p)
SELECT doc_id, nullif({redact_sql(strip_sql('cut'), *KEEP_SERIAL)}, '') AS excerpt FROM w"""


@query("debug_excerpt", EXCERPT)
def debug_excerpt(spark, sf_dir):
    d = F.col("doc_id")
    code = F.when(d % 4 == 0, F.concat(F.lit("sysc"), d.cast("string"))).when(d % 4 == 1, "E-none")
    message = F.when(d % 4 == 1, "at 10.250").otherwise("")
    step = F.when(d % 4 == 2, "tion")
    cut = excerpt.with_debug_excerpt(proxies.texts(spark, sf_dir), "text", code, message, step, 600, "excerpt")
    return cut.select("doc_id", "excerpt")


LINES = f"""WITH {TEXTS}, s AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS ls FROM texts),
lines AS (SELECT doc_id, CAST(i AS INTEGER) AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s))"""
SEVERITY_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(line, '(?i)\\b({'|'.join(w)})\\b') THEN '{s}'" for s, w in lines.SEVERITY)
    + " ELSE 'none' END"
)


@query("line_search", f"{LINES} SELECT doc_id, line_no, line FROM lines WHERE contains(lower(line), '{NEEDLE}')")
def line_search(spark, sf_dir):
    return lines.search(proxies.texts(spark, sf_dir), "text", NEEDLE.upper(), "doc_id")


@query(
    "line_hit_counts",
    f"""{LINES} SELECT doc_id, CAST(count(*) FILTER (WHERE contains(lower(line), '{NEEDLE}')) AS INTEGER) AS matching,
    CAST(count(*) AS INTEGER) AS lines FROM lines GROUP BY 1""",
)
def line_hit_counts(spark, sf_dir):
    return lines.hit_counts(proxies.texts(spark, sf_dir), "text", NEEDLE, "doc_id")


@query("line_severity", f"{LINES} SELECT doc_id, line_no, {SEVERITY_SQL} AS severity FROM lines")
def line_severity(spark, sf_dir):
    rows = lines.explode_lines(proxies.texts(spark, sf_dir), "text", "doc_id")
    return rows.select("doc_id", "line_no", lines.severity(F.col("line")).alias("severity"))


@query(
    "match_counts",
    f"""{LINES} SELECT doc_id, line_no, CAST(len(string_split(lower(line), '{NEEDLE}')) - 1 AS INTEGER) AS matches
    FROM lines WHERE contains(lower(line), '{NEEDLE}')""",
)
def match_counts(spark, sf_dir):
    rows = lines.search(proxies.texts(spark, sf_dir), "text", NEEDLE, "doc_id")
    return rows.select("doc_id", "line_no", lines.match_count(F.col("line"), NEEDLE).alias("matches"))


@query(
    "match_spans",
    f"""{LINES}, p AS (SELECT doc_id, line_no, string_split(lower(line), '{NEEDLE}') AS ps FROM lines),
    h AS (SELECT doc_id, line_no, ps, unnest(range(1, len(ps))) AS i FROM p)
    SELECT doc_id, line_no, CAST(length(array_to_string(ps[1:i], '{NEEDLE}')) AS INTEGER) AS span_start,
    CAST(length(array_to_string(ps[1:i], '{NEEDLE}')) + {len(NEEDLE)} AS INTEGER) AS span_end FROM h""",
)
def match_spans(spark, sf_dir):
    rows = lines.search(proxies.texts(spark, sf_dir), "text", NEEDLE, "doc_id")
    return rows.select("doc_id", "line_no", F.explode(lines.match_spans(F.col("line"), NEEDLE)).alias("s")).select(
        "doc_id", "line_no", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end")
    )


NORMALIZED = strip_sql(
    "regexp_replace(regexp_replace(lower(coalesce(error_message, '')), '\\d+', '#', 'g'), '\\s+', ' ', 'g')"
)
SIGNATURE = f"left(sha1(coalesce(nullif(error_code, ''), 'FAIL') || '|' || {NORMALIZED}), 16)"
SOURCE = (
    "CASE WHEN coalesce(debug_excerpt, '') <> '' THEN 'debug_excerpt' WHEN coalesce(ftrunner_snippet, '') <> ''"
    " THEN 'ftrunner_snippet' ELSE 'error_message' END"
)
CONTEXT = "coalesce(nullif(debug_excerpt, ''), nullif(ftrunner_snippet, ''), error_message, '')"


@query("normalized_message", f"WITH {RUNS} SELECT unit_id, {NORMALIZED} AS message FROM runs")
def normalized_message(spark, sf_dir):
    return proxies.runs(spark, sf_dir).select("unit_id", signature.normalized_message(F.col("error_message")).alias("message"))


@query("failure_signature", f"WITH {RUNS} SELECT unit_id, {SIGNATURE} AS signature FROM runs WHERE result = 'FAIL'")
def failure_signature(spark, sf_dir):
    failed = proxies.runs(spark, sf_dir).filter("result = 'FAIL'")
    return failed.select("unit_id", signature.signature(F.col("error_code"), F.col("error_message")).alias("signature"))


@query(
    "distinct_signatures",
    f"WITH {RUNS} SELECT count(DISTINCT {SIGNATURE}) AS signatures FROM runs WHERE result = 'FAIL'",
)
def distinct_signatures(spark, sf_dir):
    return failure_signature(spark, sf_dir).agg(F.count_distinct("signature").alias("signatures"))


@query("failed_runs", f"WITH {RUNS} SELECT unit_id, serial_number, error_code FROM runs WHERE result = 'FAIL'")
def failed_runs(spark, sf_dir):
    return proxies.runs(spark, sf_dir).filter("result = 'FAIL'").select("unit_id", "serial_number", "error_code")


@query(
    "diagnosis_context",
    f"""WITH {FAILURES} SELECT unit_id, {SOURCE} AS context_source, {CONTEXT} AS context,
    {redact_sql(CONTEXT)} AS redacted FROM failures WHERE result = 'FAIL'""",
)
def diagnosis_context(spark, sf_dir):
    failed = proxies.failures(spark, sf_dir).filter("result = 'FAIL'")
    return failed.select(
        "unit_id",
        signature.context_source().alias("context_source"),
        signature.context().alias("context"),
        signature.redacted_context().alias("redacted"),
    )
