"""One diagnosis per failure signature, joined back to every failing run."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import diagnosis as dx
from ..functions import signature as sig
from ..functions.redaction import redact
from ..operators import cache as cache_ops
from ..operators.skew import salted_lookup
from ..schema import FAIL, NO_ROOT_CAUSE, NO_SOLUTION
from ..session import stored

# A provider maps batches with unit_id, signature, error_code, error_message and
# context to batches with unit_id, root_cause, suggested_solution and source. A
# request without an answer is marked; of several answers to one the least counts.
Provider = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

REQUEST = ("unit_id", "signature", "error_code", "error_message", "context")
ANSWER = "unit_id string, root_cause string, suggested_solution string, source string"
UNANSWERED = "error"


class Diagnosis(NamedTuple):
    """Runs with their diagnosis, the answers behind it, and the cache after the batch."""

    runs: DataFrame
    outcome: DataFrame
    cache: DataFrame


def prepare(
    runs: DataFrame, provider: str = "offline_stub", model_identity: dict[str, object] | None = None
) -> DataFrame:
    """Failing runs with signature, masked message and context, and cache key."""
    failed = runs.filter(F.col("result") == FAIL)
    masked = failed.withColumns(
        {
            "signature": sig.signature(F.col("error_code"), F.col("error_message")),
            "analysis_context_source": sig.context_source(),
            "redacted_snippet": sig.redacted_context(),
            "redacted_message": redact(F.col("error_message")),
        }
    )
    return masked.withColumn(
        "analysis_cache_key",
        dx.cache_key(
            F.col("error_code"),
            F.col("redacted_message"),
            F.col("redacted_snippet"),
            F.col("analysis_context_source"),
            F.col("signature"),
            provider,
            model_identity,
        ),
    )


def representatives(prepared: DataFrame) -> DataFrame:
    """The first failing run of each signature, with the number of runs it stands for.

    Ids are compared first; the texts are fetched for the chosen runs only, so
    the aggregation never moves them. Run ids are unique, which keeps the second
    step balanced.
    """
    chosen = prepared.groupBy("signature").agg(
        F.min_by("unit_id", F.struct("start_time", "unit_id")).alias("unit_id"),
        F.count(F.lit(1)).alias("signature_runs"),
    )
    return requests(prepared.join(chosen.drop("signature"), "unit_id"), "signature_runs")


def requests(prepared: DataFrame, *more: str) -> DataFrame:
    """What a provider is asked about the given prepared runs, and what the cache keeps of them."""
    return prepared.select(
        "signature",
        *more,
        "unit_id",
        "error_code",
        F.col("redacted_message").alias("error_message"),
        F.col("redacted_snippet").alias("context"),
        F.col("analysis_context_source").alias("context_source"),
        F.col("analysis_cache_key").alias("cache_key"),
        "product_code",
        "failing_step",
    )


def stub_answer(work: DataFrame) -> dict[str, Column]:
    return {
        "root_cause": dx.stub_root_cause(F.col("error_code"), F.col("error_message")),
        "suggested_solution": dx.stub_solution(),
        "source": F.lit("stub"),
    }


def answer(work: DataFrame, provider: Provider | None = None) -> DataFrame:
    """One answer for every row of ``work`` (unique by unit_id); without a provider the fixed stub texts.

    Answers of a real provider are written to the shared folder at once, so a
    lost executor does not repeat calls that later steps have already used.
    """
    if provider is None:
        return work.withColumns(stub_answer(work)).select("unit_id", "root_cause", "suggested_solution", "source")
    given = stored(work.select(*REQUEST).mapInPandas(provider, ANSWER), "answers")
    least = F.min(F.struct("source", "root_cause", "suggested_solution"))
    one = given.groupBy("unit_id").agg(least.alias("a"))
    return (
        work.select("unit_id")
        .join(one, "unit_id", "left")
        .select(
            "unit_id",
            F.coalesce("a.root_cause", F.lit(NO_ROOT_CAUSE)).alias("root_cause"),
            F.coalesce("a.suggested_solution", F.lit(NO_SOLUTION)).alias("suggested_solution"),
            F.coalesce("a.source", F.lit(UNANSWERED)).alias("source"),
        )
    )


def diagnose(firsts: DataFrame, cache: DataFrame, provider: Provider | None = None) -> DataFrame:
    """One row per signature: its answer, from the cache where it holds one."""
    columns = [*firsts.columns, "root_cause", "suggested_solution", "source"]
    found = cache_ops.lookup(firsts, cache)
    if provider is None:
        stub = stub_answer(found)
        known = {
            "root_cause": F.coalesce(F.col("root_cause"), stub["root_cause"]),
            "suggested_solution": F.coalesce(F.col("suggested_solution"), stub["suggested_solution"]),
            "source": F.when(F.col("hit"), "local-cache").otherwise("stub"),
        }
        return found.withColumns(known).select(*columns)
    known = found.filter("hit").withColumn("source", F.lit("local-cache"))
    work = cache_ops.misses(firsts, cache)
    answered = work.join(answer(work, provider), "unit_id")
    return known.select(*columns).unionByName(answered.select(*columns))


def fan_out(prepared: DataFrame, outcome: DataFrame, min_rows: int = 100_000) -> DataFrame:
    """Give every failing run the answer of its signature.

    The first run carries the answer's own source; later ones say where theirs
    was found. A signature shared by very many runs, as ``signature_runs`` tells,
    is joined in salted parts.
    """
    small = outcome.select(
        "signature",
        "root_cause",
        "suggested_solution",
        F.col("source").alias("_source"),
        F.col("unit_id").alias("_first"),
    )
    joined = salted_lookup(
        prepared,
        small,
        ["signature"],
        spread=["unit_id"],
        counted=outcome.select("signature", F.col("signature_runs").alias("_rows")),
        min_rows=min_rows,
    )
    repeated = F.col("_source").isin("local-cache", UNANSWERED)
    later = F.when(repeated, F.col("_source")).when(F.col("_source").isNotNull(), "cached").otherwise(UNANSWERED)
    return joined.withColumn(
        "analysis_source", F.when(F.col("unit_id") == F.col("_first"), F.col("_source")).otherwise(later)
    ).drop("_source", "_first")


def diagnose_failures(
    runs: DataFrame,
    cache: DataFrame,
    provider: Provider | None = None,
    provider_name: str = "offline_stub",
    model_identity: dict[str, object] | None = None,
) -> DataFrame:
    """All failing runs with their diagnosis.

    The masked texts feed both the choice of the first runs and the join back,
    so they are written once instead of being masked twice.
    """
    prepared = stored(prepare(runs, provider_name, model_identity), "prepared")
    return fan_out(prepared, diagnose(representatives(prepared), cache, provider))


def diagnose_batch(
    runs: DataFrame,
    cache: DataFrame,
    now: Column,
    provider: Provider | None = None,
    provider_name: str = "offline_stub",
    model_identity: dict[str, object] | None = None,
) -> Diagnosis:
    """The whole batch: diagnosed runs, one answer per signature, and the cache with hits touched and answers added."""
    prepared = stored(prepare(runs, provider_name, model_identity), "prepared")
    outcome = stored(diagnose(representatives(prepared), cache, provider), "outcome")
    touched = cache_ops.touch(cache, outcome.filter(F.col("source") == "local-cache").select("cache_key"), now)
    return Diagnosis(
        fan_out(prepared, outcome),
        outcome,
        cache_ops.upsert(touched, cache_entries(outcome, provider_name, identity_text(provider_name, model_identity)), now),
    )


def identity_text(provider_name: str, model_identity: dict[str, object] | None) -> str:
    """The model's identity as compact JSON with sorted names."""
    return json.dumps(model_identity or {"provider": provider_name}, sort_keys=True, separators=(",", ":"))


def cache_entries(
    outcome: DataFrame,
    provider_name: str = "offline_stub",
    model_identity: str = '{"provider":"offline_stub"}',
    source: str = "source",
) -> DataFrame:
    """Cache rows to :func:`~logyield.operators.cache.upsert` after a batch."""
    return outcome.select(
        "cache_key",
        "root_cause",
        "suggested_solution",
        F.col(source).alias("source"),
        F.lit(provider_name).alias("provider"),
        F.lit(model_identity).alias("model_identity"),
        F.lit(dx.CACHE_PROMPT_VERSION).alias("prompt_version"),
        cache_ops.metadata({k: F.col(k) for k in cache_ops.METADATA_KEYS}).alias("metadata"),
        F.col("unit_id").alias("seq"),
    )


def forced_answers(prepared: DataFrame, unit_ids: Column, provider: Provider | None = None) -> DataFrame:
    """Fresh answers, one per chosen run, past both caches. ``unit_ids`` is a predicate over the prepared runs."""
    work = requests(prepared.filter(unit_ids))
    return work.join(answer(work, provider), "unit_id")


def reanalyze(
    diagnosed: DataFrame, prepared: DataFrame, unit_ids: Column, provider: Provider | None = None
) -> DataFrame:
    """Forced answers put back in place; other runs, and runs that did not fail, stay as they are."""
    return splice(diagnosed, forced_answers(prepared, unit_ids, provider))


def reanalyze_batch(
    diagnosed: DataFrame,
    prepared: DataFrame,
    unit_ids: Column,
    cache: DataFrame,
    now: Column,
    provider: Provider | None = None,
    provider_name: str = "offline_stub",
    model_identity: dict[str, object] | None = None,
) -> Diagnosis:
    """Like :func:`reanalyze`, with the answers kept: a forced answer replaces the cache's entry for its key."""
    forced = stored(forced_answers(prepared, unit_ids, provider), "forced")
    fresh = cache_entries(forced, provider_name, identity_text(provider_name, model_identity))
    return Diagnosis(splice(diagnosed, forced), forced, cache_ops.upsert(cache, fresh, now))


def splice(diagnosed: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the diagnosis of the runs named in ``updates`` (unique by unit_id)."""
    new = updates.select(
        "unit_id",
        F.col("root_cause").alias("_root"),
        F.col("suggested_solution").alias("_solution"),
        F.col("source").alias("_source"),
    )
    hit = F.col("_source").isNotNull()
    pick = lambda fresh, old: F.when(hit, F.col(fresh)).otherwise(F.col(old))
    return (
        diagnosed.join(new, "unit_id", "left")
        .withColumns(
            {
                "root_cause": pick("_root", "root_cause"),
                "suggested_solution": pick("_solution", "suggested_solution"),
                "analysis_source": pick("_source", "analysis_source"),
            }
        )
        .drop("_root", "_solution", "_source")
    )
