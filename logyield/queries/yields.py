"""Manager tables over both proxy run tables."""

from __future__ import annotations

from ..operators import yields
from ..sources import proxies
from .registry import query
from .sql import KEY, RUNS, RUNS_LARGE, TIME_DESC, pct

SUMMARY = f""", keyed AS (SELECT *, {KEY} AS unit_key FROM runs),
firsts AS (SELECT result FROM (SELECT result, row_number() OVER (PARTITION BY unit_key
    ORDER BY start_time ASC NULLS FIRST, unit_id) AS rn FROM keyed) WHERE rn = 1),
f AS (SELECT count(*) AS unique_units, count(*) FILTER (WHERE result = 'PASS') AS fpy_pass,
    count(*) FILTER (WHERE result IN ('PASS', 'FAIL')) AS fpy_total FROM firsts),
t AS (SELECT count(*) AS total_runs, count(*) FILTER (WHERE result = 'PASS') AS passed,
    count(*) FILTER (WHERE result = 'FAIL') AS failed, count(*) FILTER (WHERE result = 'UNKNOWN') AS unknown FROM runs)
SELECT total_runs, unique_units, passed, failed, unknown, fpy_pass, fpy_total,
    {pct('fpy_pass', 'fpy_total')} AS fpy, total_runs - unique_units AS retests FROM t, f"""

PASS_FAIL = """count(*) FILTER (WHERE result = 'PASS') AS "pass", count(*) FILTER (WHERE result = 'FAIL') AS fail"""
LABEL = (
    "CASE WHEN coalesce(error_message, '') <> '' THEN coalesce(nullif(error_code, ''), 'FAIL') || ': ' ||"
    " left(error_message, 60) ELSE coalesce(nullif(error_code, ''), 'UNKNOWN') END"
)
STATION = "coalesce(nullif(host, ''), 'unknown') || ' / ST' || coalesce(nullif(station_id, ''), '?')"
LOT = "coalesce(nullif(lot_id, ''), 'unknown')"

DAILY = f""" SELECT date, "pass", fail, {pct('"pass"', '("pass" + fail)')} AS yield FROM (
  SELECT strftime(start_time, '%Y-%m-%d') AS date, {PASS_FAIL} FROM runs
  WHERE start_time IS NOT NULL AND result IN ('PASS', 'FAIL') GROUP BY 1)"""


def grouped(name: str, label: str) -> str:
    return f""" SELECT {name}, "pass", fail, "pass" + fail AS total, {pct('"pass"', '("pass" + fail)')} AS yield FROM (
  SELECT {label} AS {name}, {PASS_FAIL} FROM runs WHERE result IN ('PASS', 'FAIL') GROUP BY 1)"""


def pareto(top: int | None) -> str:
    return f""", c AS (SELECT {LABEL} AS reason, count(*) AS n FROM runs WHERE result = 'FAIL' GROUP BY 1),
r AS (SELECT reason, n, CAST(sum(n) OVER () AS BIGINT) AS total,
    CAST(sum(n) OVER (ORDER BY n DESC, reason ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM c)
SELECT reason, n AS "count", {pct('n', 'total')} AS pct, {pct('cum', 'total')} AS cum_pct
FROM r{f' ORDER BY n DESC, reason LIMIT {top}' if top else ''}"""


PRODUCT = f""", keyed AS (SELECT *, {KEY} AS unit_key, coalesce(nullif(product_code, ''), 'UNKNOWN') AS product FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY product, unit_key ORDER BY {TIME_DESC}) AS rn FROM keyed),
s AS (SELECT product AS product_code, count(*) FILTER (WHERE rn = 1) AS total,
  count(*) FILTER (WHERE rn = 1 AND result = 'PASS') AS "pass", count(*) FILTER (WHERE rn = 1 AND result = 'FAIL') AS fail,
  count(*) AS run_count FROM ranked GROUP BY 1)
SELECT product_code, total, "pass", fail, run_count, total - "pass" - fail AS unknown,
  {pct('"pass"', 'total')} AS final_yield, run_count - total AS retests FROM s"""

for _name, _job, _sql, _dims in (
    ("manager_summary", yields.manager_summary, SUMMARY, ()),
    ("daily_yield", yields.daily_yield, DAILY, ()),
    ("failure_pareto", yields.failure_pareto, pareto(10), ()),
    ("station_breakdown", yields.station_breakdown, grouped("station", STATION), ("host",)),
    ("lot_comparison", yields.lot_comparison, grouped("lot", LOT), ("lot_id",)),
    ("product_summary", yields.product_summary, PRODUCT, ("product_code",)),
):
    query(_name, f"WITH {RUNS}{_sql}")(lambda spark, sf_dir, job=_job: job(proxies.runs(spark, sf_dir)))
    query(f"{_name}_large", f"WITH {RUNS_LARGE}{_sql}")(
        lambda spark, sf_dir, job=_job, dims=_dims: job(proxies.runs_large(spark, sf_dir, *dims))
    )

for _name, _top in (("pareto_top5", 5), ("top_failure", 1)):
    query(_name, f"WITH {RUNS}{pareto(_top)}")(
        lambda spark, sf_dir, top=_top: yields.failure_pareto(proxies.runs(spark, sf_dir), top)
    )


@query("pareto_cumulative", f"WITH {RUNS}{pareto(None)}")
def pareto_cumulative(spark, sf_dir):
    return yields.cumulative_shares(proxies.runs(spark, sf_dir))
