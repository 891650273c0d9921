"""Joins and rankings that stay balanced when one key owns a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

# Any key above 0.1 % of the rows is among the 1000 most frequent ones, so the
# broadcast list of hot keys has a fixed upper size whatever the data volume.
MAX_HOT_KEYS = 1000
SALTS = 64


def hot_keys(counted: DataFrame, keys: Sequence[str], weight: str, min_rows: int) -> DataFrame:
    """The at most ``MAX_HOT_KEYS`` heaviest keys with ``min_rows`` rows or more."""
    return (
        counted.filter(F.col(weight) >= min_rows)
        .orderBy(F.col(weight).desc(), *keys)
        .limit(MAX_HOT_KEYS)
        .select(*keys, F.lit(True).alias("_hot"))
    )


def salted_lookup(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    weight: str = "_rows",
    min_rows: int = 100_000,
) -> DataFrame:
    """Join ``big`` to the key-unique ``small``, spreading hot keys over salts where their counts are known.

    ``counted`` holds rows per key (``weight``) from an earlier step; ``big`` is
    never read again to count. Without it the join is a plain one, whose skewed
    partitions AQE splits as it measures them.

    Rows of a hot key in ``big`` are dealt to ``SALTS`` sub-keys by a hash of
    ``spread``; only the matching rows of ``small`` are repeated that often.
    Every other key keeps one sub-key, so cold data is not replicated. Neither
    input is broadcast; AQE may still turn the join into one after it has
    measured the shuffled size.
    """
    if counted is None:
        return big.join(small, list(keys), how)
    hot = F.broadcast(hot_keys(counted, keys, weight, min_rows))
    left = (
        big.join(hot, list(keys), "left")
        .withColumn(
            "_salt",
            F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0),
        )
        .drop("_hot")
    )
    right = (
        small.join(hot, list(keys), "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            ),
        )
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ranked_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: Sequence[Column],
    rank: str = "rank",
    total: str = "group_rows",
) -> DataFrame:
    """Exact 1-based rank and group size without sorting a whole group in one task.

    ``buckets`` must be monotone in ``order`` (ascending, nulls first). Rows are
    ranked inside (key, bucket); the running count of earlier buckets, computed
    on one row per bucket, is added afterwards. The join reuses the (key,
    bucket) partitioning of the first window.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    packed = df.withColumns({"_bucket": F.struct(*[b.alias(n) for b, n in zip(buckets, names)])}).withColumn(
        "_bucket", F.to_json("_bucket")
    ).withColumns({n: b for n, b in zip(names, buckets)})
    group = [*keys, "_bucket"]
    local = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    ranked = packed.withColumn("_local", F.row_number().over(local)).drop(*names)
    before = (
        Window.partitionBy(*keys)
        .orderBy(*[F.col(n).asc_nulls_first() for n in names])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        packed.groupBy(*group, *names)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                total: F.sum("_n").over(Window.partitionBy(*keys)),
            }
        )
        .select(*group, "_offset", total)
    )
    return (
        ranked.join(offsets, group)
        .withColumn(rank, (F.col("_offset") + F.col("_local")).cast("long"))
        .drop("_bucket", "_local", "_offset")
    )


def exact_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rank: str = "rank", total: str = "group_rows"
) -> DataFrame:
    """Exact 1-based rank (ascending, nulls first) and group size, whatever share of the rows a key or a moment has.

    Rows are dealt to ranges of (keys, order), which Spark cuts where the rows are, so no range is much larger than another
    unless whole rows of keys and order are equal. The ranges are stored; a group's rows are numbered inside
    each range, and the counts of its earlier ranges, at most one row per range, are added.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    ranged = stored(df.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy(*keys, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
                total: F.sum("_n").over(Window.partitionBy(*keys)),
            }
        )
        .drop("_n")
    )
    numbered = ranged.withColumn("_local", F.row_number().over(local)).join(offsets, [*keys, "_range"])
    return numbered.withColumn(rank, (F.col("_offset") + F.col("_local")).cast("long")).drop("_range", "_local", "_offset")
