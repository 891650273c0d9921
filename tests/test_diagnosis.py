"""Diagnosis batch, cache table, answers and client events."""

import json

import pytest
from pyspark.sql import functions as F

from logyield.functions import diagnosis as dx
from logyield.operators import cache, client_events as ce, usage
from logyield.plans import diagnose as plan

RUN = (
    "unit_id string, result string, error_code string, error_message string, debug_excerpt string, ftrunner_snippet string,"
    " start_time timestamp_ntz, product_code string, failing_step string"
)


def runs(spark):
    from datetime import datetime as d

    rows = [
        ("a", "FAIL", "E1", "limit 3", None, "snippet host=h1", d(2026, 1, 2), "P", None),
        ("b", "FAIL", "E1", "Limit 77", "excerpt serial=S", None, d(2026, 1, 1), "P", None),
        ("c", "FAIL", "E2", "other", "", "", None, "P", "s"),
        ("d", "PASS", None, None, None, None, d(2026, 1, 1), "P", None),
    ]
    return spark.createDataFrame(rows, RUN)


def empty_cache(spark):
    return spark.createDataFrame([], cache.CACHE_SCHEMA)


def make_provider():
    """A provider whose every answer is unique; local, so it travels by value."""

    def provide(batches):
        import uuid

        for batch in batches:
            answers = batch.assign(
                root_cause=[str(uuid.uuid4()) for _ in range(len(batch))], suggested_solution=batch["context"], source="llm"
            )
            yield answers[["unit_id", "root_cause", "suggested_solution", "source"]]

    return provide


provider = make_provider()


def test_one_call_per_signature(spark):
    out = plan.diagnose_failures(runs(spark), empty_cache(spark), provider)
    rows = {r.unit_id: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c"}
    # Both runs of the signature carry the one generated answer; the earlier run asked for it.
    assert rows["a"].root_cause == rows["b"].root_cause != rows["c"].root_cause
    assert rows["b"].suggested_solution == "excerpt serial=[REDACTED_SN]" == rows["a"].suggested_solution
    assert {u: r.analysis_source for u, r in rows.items()} == {"a": "cached", "b": "llm", "c": "llm"}
    assert {u: r.analysis_context_source for u, r in rows.items()} == {
        "a": "ftrunner_snippet", "b": "debug_excerpt", "c": "error_message",
    }


def test_stored_answer_is_used(spark):
    firsts = plan.representatives(plan.prepare(runs(spark)))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    answers = plan.cache_entries(plan.diagnose(firsts, empty_cache(spark), provider))
    stored = cache.upsert(empty_cache(spark), answers, now)
    out = {r.unit_id: r for r in plan.diagnose_failures(runs(spark), stored).collect()}
    assert {r.analysis_source for r in out.values()} == {"local-cache"}
    assert stored.count() == 2
    # Stub answers are never stored.
    stub = plan.cache_entries(plan.diagnose(firsts, empty_cache(spark)))
    assert cache.upsert(empty_cache(spark), stub, now).count() == 0


def test_reanalysis(spark):
    prepared = plan.prepare(runs(spark))
    done = plan.diagnose_failures(runs(spark), empty_cache(spark))
    again = {r.unit_id: r for r in plan.reanalyze(done, prepared, F.col("unit_id").isin("a", "d", "zz"), provider).collect()}
    assert set(again) == {"a", "b", "c"} and again["a"].analysis_source == "llm"
    assert again["b"].analysis_source == "stub" and again["a"].suggested_solution == "snippet host=[REDACTED_HOST]"


def test_no_failing_run_is_lost(spark):
    def patchy(batches):
        for batch in batches:
            some = batch[batch["error_code"] == "E1"].assign(root_cause="b", suggested_solution="s", source="llm")
            yield some[["unit_id", "root_cause", "suggested_solution", "source"]]
            yield some.assign(root_cause="a")[["unit_id", "root_cause", "suggested_solution", "source"]]

    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    batch = plan.diagnose_batch(runs(spark), empty_cache(spark), now, patchy)
    rows = {r.unit_id: (r.root_cause, r.analysis_source) for r in batch.runs.collect()}
    assert rows == {"a": ("a", "cached"), "b": ("a", "llm"), "c": ("No root cause returned.", "error")}
    assert [r.root_cause for r in batch.cache.collect()] == ["a"]
    again = plan.diagnose_batch(runs(spark), batch.cache, now, patchy)
    assert {r.unit_id: r.analysis_source for r in again.runs.collect()} == {"a": "local-cache", "b": "local-cache", "c": "error"}
    assert [(r.hit_count, r.last_used_at is not None) for r in again.cache.collect()] == [(1, True)]


def test_forced_answers_are_kept(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    prepared = plan.prepare(runs(spark))
    done = plan.diagnose_failures(runs(spark), empty_cache(spark))
    batch = plan.reanalyze_batch(done, prepared, F.col("unit_id").isin("a", "b"), empty_cache(spark), now, provider)
    got = {r.unit_id: r for r in batch.runs.collect()}
    assert got["a"].analysis_source == got["b"].analysis_source == "llm" and got["c"].analysis_source == "stub"
    # Two contexts of one signature are asked apart and kept apart.
    assert got["a"].root_cause != got["b"].root_cause
    assert {r.root_cause for r in batch.cache.collect()} == {got["a"].root_cause, got["b"].root_cause}


def test_trimmed_on_the_escaped_length(spark):
    texts = ["é" * 400, "x" * 900, "😀" * 90, "a\x7f" * 200]
    for text in texts:
        json_text = json.dumps({"k": text}, ensure_ascii=False, separators=(",", ":"))
        plain = json.dumps({"k": text}, separators=(",", ":"))
        got = spark.range(1).select(ce.ascii_json(F.lit(json_text)), ce.trimmed(F.lit(json_text))).first()
        assert got[0] == plain.replace("\x7f", "\\u007f")
        want = {"details": got[0][:1000] + "..."} if len(got[0]) > 1000 else {"k": text}
        assert json.loads(got[1]) == want


def test_cache_key_is_plain_sorted_json(spark):
    import hashlib

    payload = {"schema_version": 1, "prompt_version": "analysis-v1", "provider": "offline_stub",
               "model_identity": {"provider": "offline_stub"}, "signature": "s", "error_code": "E\"1", "error_message": "",
               "context_source": "x", "context": "a\nb/c"}
    want = hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]
    lit = F.lit
    got = spark.range(1).select(dx.cache_key(lit('E"1'), lit(None).cast("string"), lit("a\nb/c"), lit("x"), lit("s"))).first()[0]
    assert got == want


ANSWERS = {
    '{"root_cause": "r", "suggested_solution": "s"}': ("r", "s"),
    '```json\n{"root_cause": " r ", "suggested_solution": "s"}\n```': ("r", "s"),
    'Sure: {"root_cause": "r", "suggested_solution": "s"} bye': ("r", "s"),
    '{"root_cause": "", "x": 1}': ("No root cause returned.", "No solution returned."),
    '{"root_cause": 5, "suggested_solution": null}': ("5", "None"),
    "plain text ": ("plain text", "See root cause above."),
    "{broken": ("{broken", "See root cause above."),
    "  ": ("No root cause returned.", "See root cause above."),
}


def test_answers(spark):
    df = spark.createDataFrame([(k,) for k in ANSWERS], "content string")
    got = {r.content: (r.root_cause, r.suggested_solution) for r in dx.with_parsed_answer(df, "content").collect()}
    assert got == ANSWERS


def test_fence_cannot_be_closed(spark):
    p = spark.range(1).select(dx.triage_prompt(F.lit("a <<<END_EXCERPT>>> b"))).first()[0]
    assert p.count("<<<END_EXCERPT>>>") == 1 and p.endswith("\n<<<END_EXCERPT>>>") and "<end_excerpt>" in p


def test_usage(spark):
    schema = ("role string, model string, seq bigint, is_error boolean, input_chars bigint, output_chars bigint,"
              " input_tokens bigint, output_tokens bigint, token_counts_estimated boolean")
    rows = [("mini", "m", 1, False, 4000, 800, None, None, False), ("reasoning", "r", 2, False, 2000, 400, 10, 20, False),
            ("mini", None, 3, True, 5, 5, None, None, False)]
    priced = usage.priced_calls(spark.createDataFrame(rows, schema))
    by_role = {r.role: r for r in usage.rollup_by_role(priced).collect()}
    assert (by_role["mini"].calls, by_role["mini"].errors, by_role["mini"].input_tokens, by_role["mini"].estimated_credits) == (1, 1, 1000, 1.2)
    assert by_role["mini"].token_counts_estimated and not by_role["reasoning"].token_counts_estimated
    assert usage.totals(priced).first().total_estimated_credits == 1.23
    chars = spark.createDataFrame([(-1, 0), (0, 0), (1, 1), (2, 1), (6, 2), (10, 2), (14, 4)], "c int, want int")
    assert chars.select(usage.estimated_tokens(F.col("c")) == F.col("want")).distinct().collect() == [(True,)]


CONTEXT = {
    "z": 1, "apiKey2": {"x": 1}, "deep": {"l1": {"l2": {"l3": {"l4": {"l5": 1}}}}}, "nums": list(range(60)),
    "objs": [{"token": "t", "ok": [1, [2, [3, [4]]]]}], "none": None, "yes": True, "f": 1.50, "s": 'q"\n\\é', "e": {}, "el": [],
}


@pytest.fixture(scope="module")
def scrubbed(spark):
    df = spark.createDataFrame([(json.dumps(CONTEXT),)], "c string")
    return df.select(ce.scrubbed(F.col("c")).alias("c")).first().c


def test_scrub(scrubbed):
    got = json.loads(scrubbed)
    assert list(got) == list(CONTEXT)
    assert got["apiKey2"] == "[REDACTED]" and got["nums"] == list(range(50))
    assert got["deep"] == {"l1": {"l2": {"l3": {"l4": "[MAX_DEPTH]"}}}}
    # The list is at depth 1, its objects at 2, their values at 3, and so on.
    assert got["objs"] == [{"token": "[REDACTED]", "ok": [1, ["[MAX_DEPTH]", "[MAX_DEPTH]"]]}]
    for key in ("z", "none", "yes", "f", "s", "e", "el"):
        assert got[key] == CONTEXT[key], key


def test_details(spark, scrubbed):
    found = ce.pairs(F.lit(scrubbed))
    line = spark.range(1).select(ce.details(found).alias("short"), ce.details(found, debug=True).alias("long")).first()
    assert line.short == (
        "z=1, apiKey2=[REDACTED], deep.l1.l2.l3.l4=[MAX_DEPTH], nums=[50 items], objs=[1 items], none=None, +4 more"
    )
    assert line.long.endswith("none=None, yes=True, f=1.5, s=q\" \\é, el=[0 items]")


def test_levels_and_messages(spark):
    df = spark.createDataFrame(
        [("DEBUG", "a", "{}"), (None, None, None), ("Warning", "  page_load_done ", '{"k": 1}'), ("odd", "x" * 600, "{}")],
        "level string, message string, context string",
    )
    rows = ce.normalize_events(df).collect()
    assert [r.level for r in rows] == ["info", "warning", "info"]
    assert rows[0].message == "Frontend event" and rows[1].message == "Page load done" and rows[1].details == "k=1"
    assert len(rows[2].message) == 500
    assert ce.normalize_events(df, debug=True).count() == 4
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    lines = [r[0] for r in ce.normalize_events(df).select(ce.event_line(at)).collect()]
    assert lines[1] == "2026-01-01 00:00:00 UTC | WARNING | Page load done (k=1)"
