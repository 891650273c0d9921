"""The diagnosis cache as a table with one row per cache key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NO_ROOT_CAUSE, NO_SOLUTION

CACHE_SCHEMA = (
    "cache_key string, root_cause string, suggested_solution string, source string, provider string,"
    " model_identity string, prompt_version string, created_at timestamp_ntz, updated_at timestamp_ntz,"
    " last_used_at timestamp_ntz, hit_count bigint, metadata map<string,string>"
)
# What is stored, kept metadata keys and their length.
STORED_SOURCE = "llm"
METADATA_KEYS = (
    "signature",
    "error_code",
    "error_message",
    "context_source",
    "unit_id",
    "product_code",
    "failing_step",
)
METADATA_CHARS = 240


def metadata(columns: dict[str, Column]) -> Column:
    """Whitelisted, shortened metadata without nulls, in key order."""
    kept = sorted(k for k in METADATA_KEYS if k in columns)
    keys = F.array(*[F.lit(k) for k in kept])
    values = F.array(*[F.substring(columns[k].cast("string"), 1, METADATA_CHARS) for k in kept])
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v.isNotNull())


def lookup(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``hit`` and the stored texts (defaults for blank ones) by ``cache_key``."""
    text = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default)).alias(c)
    stored = cache.select(
        "cache_key", text("root_cause", NO_ROOT_CAUSE), text("suggested_solution", NO_SOLUTION), F.lit(True).alias("hit")
    )
    return work.join(stored, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def misses(work: DataFrame, cache: DataFrame) -> DataFrame:
    """Work whose key the cache does not hold."""
    return work.join(cache.select("cache_key"), "cache_key", "left_anti")


def touch(cache: DataFrame, used_keys: DataFrame, now: Column) -> DataFrame:
    """Record look-ups: one more hit per use and a new last-used time."""
    uses = used_keys.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_uses"))
    return (
        cache.join(uses, "cache_key", "left")
        .withColumns(
            {
                "last_used_at": F.when(F.col("_uses").isNotNull(), now).otherwise(F.col("last_used_at")),
                "hit_count": F.col("hit_count") + F.coalesce("_uses", F.lit(0)),
            }
        )
        .drop("_uses")
    )


def upsert(cache: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Add or replace entries; a replaced entry keeps its creation time and hit count.

    Only provider results are stored. ``fresh`` may repeat a key: the row with
    the greatest ``seq`` wins.
    """
    values = [c for c in cache.columns if c not in ("cache_key", "created_at", "updated_at", "last_used_at", "hit_count")]
    newest = (
        fresh.filter(F.col("source") == STORED_SOURCE)
        .groupBy("cache_key")
        .agg(F.max_by(F.struct(*values), F.col("seq")).alias("n"))
    )
    both = cache.alias("c").join(newest.alias("n"), "cache_key", "full_outer")
    is_new = F.col("n.n").isNotNull()
    pick = {v: F.when(is_new, F.col(f"n.n.{v}")).otherwise(F.col(f"c.{v}")).alias(v) for v in values}
    pick["cache_key"] = F.col("cache_key")
    pick["created_at"] = F.coalesce(F.col("c.created_at"), now).alias("created_at")
    pick["updated_at"] = F.when(is_new, now).otherwise(F.col("c.updated_at")).alias("updated_at")
    pick["last_used_at"] = F.when(is_new, now).otherwise(F.col("c.last_used_at")).alias("last_used_at")
    pick["hit_count"] = F.coalesce(F.col("c.hit_count"), F.lit(0).cast("long")).alias("hit_count")
    return both.select(*[pick[c] for c in cache.columns])


def delete(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """The cache without the given keys."""
    return cache.join(keys.select("cache_key").distinct(), "cache_key", "left_anti")


def deleted_count(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """How many entries :func:`delete` removes."""
    hit = cache.select("cache_key").join(keys.select("cache_key").distinct(), "cache_key", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("deleted"))


def batch_keys(diagnosed: DataFrame) -> DataFrame:
    """Distinct cache keys used by a batch."""
    used = diagnosed.select(F.col("analysis_cache_key").alias("cache_key"))
    return used.filter(F.col("cache_key").isNotNull()).distinct()


def forget_keys(diagnosed: DataFrame) -> DataFrame:
    """The batch after its cache entries were cleared."""
    return diagnosed.withColumn("analysis_cache_key", F.lit(None).cast("string"))


def listing(cache: DataFrame) -> DataFrame:
    """Entries, most recently used first."""
    return cache.orderBy(F.coalesce("last_used_at", "updated_at").desc_nulls_last(), "cache_key")


def clearable(diagnosed: DataFrame) -> DataFrame:
    """Runs whose diagnosis sits in the cache and may be cleared."""
    return diagnosed.filter(
        F.col("analysis_cache_key").isNotNull() & F.col("analysis_source").isin("llm", "local-cache")
    )
