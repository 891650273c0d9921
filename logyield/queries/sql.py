"""SQL twins of ``logyield.sources.proxies`` and shared oracle fragments."""

RUNS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
runs AS (
  SELECT CAST(event_id AS VARCHAR) AS unit_id,
    CASE WHEN user_id % 29 <> 0 THEN 'SN' || user_id END AS serial_number,
    'P' || (user_id % 5) AS product_code,
    CASE WHEN event_id % 7 <> 0 THEN 'LOT' || (event_id % 6) END AS lot_id,
    'OP' || (user_id % 3) AS op_id,
    CAST(event_id % 4 AS VARCHAR) AS station_id,
    CASE WHEN event_id % 11 <> 0 THEN 'H' || (user_id % 3) END AS host,
    CASE WHEN event_id % 101 <> 0 THEN ts END AS start_time,
    CASE WHEN event_id % 13 <> 0 THEN ts + to_seconds(event_id % 600) END AS end_time,
    value AS duration_s,
    CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'UNKNOWN' ELSE 'PASS' END AS result,
    CASE WHEN event_type = 'error' AND event_id % 17 <> 0 THEN 'E' || (k % 7) END AS error_code,
    CASE WHEN event_type = 'error' AND event_id % 19 <> 0 THEN 'Limit ' || k || '  exceeded' END AS error_message,
    CASE WHEN event_type = 'error' THEN 'Step' || (k % 9) END AS failing_step,
    'STC_WW' || (user_id % 52) || '___' || event_id AS run_folder,
    CASE user_id % 4 WHEN 0 THEN 'APSE' WHEN 1 THEN 'TESTAPP' END AS test_mode,
    event_id % 3 <> 0 AS has_done_block,
    value * 8 AS total_test_time_s,
    k
  FROM ev
)
"""

RUNS_LARGE = """
runs AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS unit_id,
    CAST(l_partkey AS VARCHAR) AS serial_number, p_brand AS product_code, o_orderpriority AS lot_id,
    CAST(l_linenumber AS VARCHAR) AS op_id, CAST(l_suppkey AS VARCHAR) AS station_id, n_name AS host,
    l_shipdate AS start_time, l_shipdate AS end_time, l_quantity AS duration_s,
    CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'PASS' ELSE 'UNKNOWN' END AS result,
    CASE WHEN l_returnflag = 'R' THEN 'E' || (l_suppkey % 13) END AS error_code,
    CASE WHEN l_returnflag = 'R' THEN 'limit ' || CAST(l_quantity AS INTEGER) || ' exceeded' END AS error_message,
    CAST(NULL AS VARCHAR) AS failing_step,
    'run' || l_orderkey AS run_folder
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN orders ON o_orderkey = l_orderkey
)
"""

# Unit key, and time order with nulls first.
KEY = "CASE WHEN coalesce(serial_number, '') <> '' THEN 'serial:' || serial_number ELSE 'run:' || unit_id END"
TIME_ASC = (
    "start_time ASC NULLS FIRST, end_time ASC NULLS FIRST, run_folder ASC NULLS FIRST, unit_id ASC NULLS FIRST"
)
TIME_DESC = "start_time DESC NULLS LAST, end_time DESC NULLS LAST, run_folder DESC NULLS LAST, unit_id DESC NULLS LAST"


def pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} > 0 THEN CAST(round_even(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100e0, 2)"
        " AS DOUBLE) ELSE 0e0 END"
    )


def with_runs(body: str, base: str = RUNS) -> str:
    return f"WITH {base}{body}"

SNIPPET = (
    "concat_ws(chr(10), 'Result: FAIL', 'Failing step: ' || nullif(failing_step, ''),"
    " 'Errorcode: ' || nullif(error_code, ''), 'ErrorMsg: ' || nullif(error_message, ''))"
)

FAILURES = (
    RUNS
    + f""", failures AS (
  SELECT *, CASE WHEN result = 'FAIL' AND e % 5 = 0 THEN concat_ws(' ', 'trace of', failing_step,
      'host=' || coalesce(host, 'none'), '10.0.0.' || (e % 256), 'SerialNumber: ' || coalesce(serial_number, 'RMA1234567'),
      'said "k"=' || k) WHEN result = 'FAIL' AND e % 5 = 1 THEN '' END AS debug_excerpt,
    CASE WHEN e % 10 <> 3 AND result = 'FAIL' THEN {SNIPPET} END AS ftrunner_snippet
  FROM (SELECT *, CAST(unit_id AS BIGINT) AS e FROM runs)
)
"""
)

TEXTS = r"""
texts AS (SELECT doc_id, text || chr(10) || chr(27) || '[31mERR' || chr(27) || '[0m psexec \\srv-' || doc_id || '.lab -u sysc' || doc_id
  || ' -p tr@nsf3r cmd' || chr(10) || 'TOKEN: a' || doc_id || ' user=op' || doc_id || ' hostname : h' || doc_id
  || ' 00:1A:2b:3C:4d:5E at 10.250.0.' || (doc_id % 256) || ' SerialNumber=SN' || doc_id || ' code RMA' || (doc_id + 1000000)
  || ' [34mwarn[0m' AS text FROM documents)
"""

# Masking rules in RE2 syntax.
REDACTION = {
    "user_switch": (r"(?i)(-u\s+)\S+", r"\1[REDACTED_USER]"),
    "password_switch": (r"(?i)(-p\s+)\S+", r"\1[REDACTED_PW]"),
    "secret_pair": (r"(?i)\b(password|passwd|pwd|secret|token|apikey|api_key)\s*[=:]\s*\S+", r"\1=[REDACTED]"),
    "user_pair": (r"(?i)\b(user|username|userid|uid)\s*[=:]\s*\S+", r"\1=[REDACTED_USER]"),
    "host_pair": (r"(?i)\b(host|hostname|testserver)\s*[=:]\s*\S+", r"\1=[REDACTED_HOST]"),
    "unc_host": (r"\\\\[A-Za-z0-9._-]+", r"\\\\[REDACTED_HOST]"),
    "mac": (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "[REDACTED_MAC]"),
    "ipv4": (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    "serial_pair": (r"(?i)\b(serialnumber|child_sn|serial)\s*[=:]\s*\S+", r"\1=[REDACTED_SN]"),
    "serial_code": (r"\bRM[A-Z]{1,2}\d{6,}\b", "[REDACTED_SN]"),
}


def redact_sql(expr: str, *names: str) -> str:
    """Chained masking; all rules unless named."""
    out = f"coalesce({expr}, '')"
    for name in names or REDACTION:
        pattern, mask = REDACTION[name]
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return out


KEEP_SERIAL = tuple(n for n in REDACTION if not n.startswith("serial"))


def strip_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"
