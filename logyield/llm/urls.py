"""URL rules as a sort-merge range join.

A host written backwards, label by label (``www.example.net`` → ``net.example.www.``), turns "this host and all its
subdomains" into "all keys that start with the rule's key": an interval of the sort order. The intervals of hosts are
nested or disjoint, so one sweep over the sorted urls and rules needs only a stack of the rules open at a point. A url
asks the stack which open rules also fit its path; the longest (host and path together) wins, then the longer host, then
``block`` before ``allow``.

Rules and urls meet by ranges of the key, not by broadcast: a bounded sample of keys gives the boundaries, a rule goes
to every range that its interval touches, and each range is sorted and swept by one task. Boundaries lie in the order of
(host key, path, row hash), so a host or even one url with a third of all rows is spread over many ranges.

Null urls and urls without ``://`` have an empty host and path; no rule fits them and they get the default verdict.
Repeated rows, repeated or null ids are judged row by row. Extra columns are carried only if asked for. Without urls the
result is empty; without rules every url gets the default verdict. Equal rules collapse into one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, LOWER, shuffle_width

RULE_SCHEMA = "host string, path string, verdict string"
#: About how many keys the boundaries are taken from; only the balance of the ranges depends on it.
SAMPLED_KEYS = 8_000


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER.decode(), LOWER.decode()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where ``?`` or ``#`` follows the host at once."""
    # The path is optional: else the search would go on to a later ``://``.
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels backwards, each followed by a dot; empty for an empty host."""
    backwards = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))
    return F.when(host == "", F.lit("")).otherwise(backwards)


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """``keep`` plus host, path, rule (host + path of the winner or null) and verdict for every row of ``pages``.

    ``rules``: host, path, verdict (``allow`` or ``block``).
    """
    spark = pages.sparkSession
    base = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    urls = pages.select(*base, F.col(url).alias("_url"))
    urls = urls.select(
        *(f"_keep{i}" for i in range(len(keep))), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"),
        F.xxhash64("_url", *(f"_keep{i}" for i in range(len(keep)))).alias("_row"),
    ).withColumn("_key", host_key(F.col("host")))
    bounds = range_bounds(urls, max(1, shuffle_width(spark)))
    urls = with_ranges(urls.withColumn("_open", F.lit(0)), bounds)

    keyed = (
        rules.select(
            F.translate("host", UPPER.decode(), LOWER.decode()).alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
        )
        .where("rule_host <> '' AND rule_path IS NOT NULL")
        .distinct()
        .select(
            host_key(F.col("rule_host")).alias("_key"), F.lit("").alias("path"), F.lit(-(1 << 63)).alias("_row"),
            "rule_host", "rule_path", "verdict", F.lit(1).alias("_open"),
        )
    )
    spread = with_ranges(keyed, bounds, whole_interval=True).drop("path", "_row")
    both = spread.unionByName(urls, allowMissingColumns=True)
    kinds = dict(urls.dtypes)
    schema = ", ".join(f"_keep{i} {kinds[f'_keep{i}']}" for i in range(len(keep)))
    schema = f"{schema}{', ' if schema else ''}host string, path string, rule string, verdict string"
    swept = (
        both.repartition(len(bounds) + 1, "_range")
        .sortWithinPartitions("_range", "_key", F.desc("_open"), "path")
        .mapInArrow(sweeper(len(keep), default), schema)
    )
    return swept.select(*(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "host", "path", "rule", "verdict")


def range_bounds(urls: DataFrame, ranges: int) -> list[tuple[str, str, int]]:
    """At most ``ranges`` - 1 boundaries from a sample of the rows' keys, ``SAMPLED_KEYS`` on average at any size."""
    share = min(1.0, SAMPLED_KEYS / max(1, urls.count()))
    drawn = F.pmod(F.xxhash64("_row"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = urls.select("_key", "path", "_row").where(drawn)
    keys = sorted((r["_key"].encode(), r["path"].encode(), r["_row"]) for r in sample.collect())
    picked = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    return [(k.decode(), p.decode(), r) for k, p, r in sorted(set(picked))]


def with_ranges(rows: DataFrame, bounds: list[tuple[str, str, int]], whole_interval: bool = False) -> DataFrame:
    """``_range``: how many boundaries are not above the row; with ``whole_interval`` one row for every range that
    holds keys starting with the row's key. The boundaries number less than the shuffle partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_key", "path", "_row"))
            rows, ranges = [], []
            for i, at in enumerate(zip(*columns)):
                first = last = bisect_right(bounds, at)
                while whole_interval and last < len(bounds) and bounds[last][0].startswith(at[0]):
                    last += 1
                rows.extend([i] * (last - first + 1))
                ranges.extend(range(first, last + 1))
            taken = pa.Table.from_batches([batch]).take(pa.array(rows, pa.int64()))
            yield from taken.append_column("_range", pa.array(ranges, pa.int32())).to_batches()

    schema = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, `_range` int")


def sweeper(kept: int, default: str):
    """Sweeps ranges sorted by key with rules before urls; the stack starts empty in each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list]] = []  # (key, [(path, rule, verdict)]) of the open rules, outermost first
        current = None
        for batch in batches:
            frame = pa.Table.from_batches([batch])
            column = {n: frame.column(n).to_pylist() for n in
                      ("_range", "_key", "_open", "host", "path", "rule_host", "rule_path", "verdict")}
            asked, rules, verdicts = [], [], []
            for i, key in enumerate(column["_key"]):
                if column["_range"][i] != current:
                    current, stack = column["_range"][i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if column["_open"][i]:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, []))
                    host, path = column["rule_host"][i], column["rule_path"][i]
                    stack[-1][1].append((path, host + path, column["verdict"][i]))
                    continue
                best = None
                if key:
                    path = column["path"][i]
                    for depth, (_, open_rules) in enumerate(stack):
                        for rule_path, name, verdict in open_rules:
                            if path.startswith(rule_path):
                                rank = (len(name), depth, verdict == "block")
                                if best is None or rank > best[0]:
                                    best = (rank, name, verdict)
                asked.append(i)
                rules.append(best[1] if best else None)
                verdicts.append(best[2] if best else default)
            out = frame.select([*(f"_keep{i}" for i in range(kept)), "host", "path"]).take(pa.array(asked, pa.int64()))
            out = out.append_column("rule", pa.array(rules, pa.string()))
            yield from out.append_column("verdict", pa.array(verdicts, pa.string())).to_batches()

    return run
