"""Provider usage: token and credit estimates rolled up by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters per token, tokens per credit.
CHARS_PER_TOKEN = 4
TOKENS_PER_CREDIT = 1000


def estimated_tokens(chars: Column) -> Column:
    """0 without text, else a quarter of the characters (half to even), at least 1."""
    quarter = F.bround(chars / CHARS_PER_TOKEN, 0).cast("long")
    return F.when(chars <= 0, F.lit(0).cast("long")).otherwise(F.greatest(F.lit(1).cast("long"), quarter))


def floor0(col: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), col.cast("long"))


def credits(tokens: Column, tokens_per_credit: int = TOKENS_PER_CREDIT) -> Column:
    return F.bround(tokens / max(1, tokens_per_credit), 4)


def priced_calls(calls: DataFrame, tokens_per_credit: int = TOKENS_PER_CREDIT) -> DataFrame:
    """Fill in missing token counts and price each call.

    ``calls``: role, model, seq, is_error, input_chars, output_chars,
    input_tokens, output_tokens (nullable), token_counts_estimated.
    """
    tokens = lambda side: floor0(F.coalesce(f"{side}_tokens", estimated_tokens(F.col(f"{side}_chars"))))
    missing = F.col("input_tokens").isNull() | F.col("output_tokens").isNull()
    return (
        calls.withColumn("token_counts_estimated", F.col("token_counts_estimated") | missing)
        .withColumns(
            {
                "input_tokens": tokens("input"),
                "output_tokens": tokens("output"),
                "input_chars": floor0(F.col("input_chars")),
                "output_chars": floor0(F.col("output_chars")),
            }
        )
        .withColumn("credits", credits(F.col("input_tokens") + F.col("output_tokens"), tokens_per_credit))
    )


def rollup_by_role(priced: DataFrame) -> DataFrame:
    """Totals per role; failed calls count as errors only."""
    ok = ~F.col("is_error")
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    return priced.groupBy("role").agg(
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.count_if(ok).alias("calls"),
        F.count_if(~ok).alias("errors"),
        total("input_chars"),
        total("output_chars"),
        total("input_tokens"),
        total("output_tokens"),
        F.coalesce(F.bool_or(ok & F.col("token_counts_estimated")), F.lit(False)).alias("token_counts_estimated"),
        # Decimal sums do not depend on the order of the partial sums.
        F.coalesce(F.sum(F.when(ok, F.col("credits").cast("decimal(20,4)"))), F.lit(0))
        .cast("double")
        .alias("estimated_credits"),
    )


def totals(priced: DataFrame) -> DataFrame:
    """All roles together."""
    ok = ~F.col("is_error")
    return priced.agg(
        F.count_if(ok).alias("total_calls"),
        F.coalesce(F.sum(F.when(ok, F.col("credits").cast("decimal(20,4)"))), F.lit(0))
        .cast("double")
        .alias("total_estimated_credits"),
    )


def cache_hits(diagnosed: DataFrame) -> DataFrame:
    """Runs served without a provider call, split into this batch and the stored cache."""
    source = F.col("analysis_source")
    return diagnosed.agg(
        F.count_if(source.isin("cached", "local-cache")).alias("cache_hits"),
        F.count_if(source == "cached").alias("local_cache_hits"),
        F.count_if(source == "local-cache").alias("disk_cache_hits"),
        F.count_if(source.isin("cached", "local-cache")).alias("calls_skipped_by_cache"),
    )
