import hashlib

import pytest

import __spark_entry__ as entry_point
import check
import corpus_pipeline
from logyield.llm import packing
from logyield.llm.common import table
from logyield.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.conftest import SMALL
from tests.llm.test_decontaminate import expected as contamination
from tests.llm.test_decontaminate import windows
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import check_packing
from tests.llm.test_suffix import removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before and after every stage."""
    docs = table(spark, SMALL, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept_table(stage(spark, docs, SMALL), "test-stage")
        out.append(docs.collect())
        if len(out) <= len(corpus_pipeline.STAGES):
            assert docs.columns == COLUMNS
    return out


def pairs(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "repeated_passages", "benchmark_texts", "best_fit_packing",
    ]
    assert entry_point.queries()["pipeline"] is corpus_pipeline.run


def test_quality_stage_keeps_good_and_drops_bad(spark, stages):
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    kept = {r.doc_id for r in stages[1]}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    bad = [i for i, q in labels.items() if not q]
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1]]
    sets, group = brute(rows)
    firsts = {}
    for r, own, g in zip(rows, sets, group):
        firsts[g if own else ("empty", r[0])] = min(firsts.get(g, r), r)
    assert pairs(stages[2]) == sorted(firsts.values())


def test_passage_stage(stages):
    want = []
    for r, w in zip(stages[2], removed([(r.doc_id, r.text) for r in stages[2]], 50)):
        text = w[5].decode("utf-8", "ignore") if w[2] else r.text
        if not (w[2] and not text):
            want.append((r.doc_id, text))
    assert pairs(stages[3]) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in stages[3])


def test_benchmark_stage(spark, stages):
    wanted = windows([tuple(r) for r in table(spark, SMALL, "benchmark").collect()])
    clean = [r for r in stages[3] if not contamination(r.text, wanted)[1]]
    assert pairs(stages[4]) == pairs(clean) and len(clean) < len(stages[3]) or pairs(stages[4]) == pairs(stages[3])


CLASHING = ["_score", "_salt", "_hash", "_b", "_w", "_cut", "_row", "_row_key", "_kept_text", "label", "class_key", "id", "text_hash"]


def test_other_columns_pass_through_under_any_name(spark):
    """Names that operators use inside, with odd rows: every stage keeps each row's values beside its text."""
    from pyspark.sql import functions as F

    docs = table(spark, SMALL, "documents").limit(60)
    odd = docs.limit(1).withColumns({"text": F.lit(None).cast("string")}).select(*COLUMNS)
    odd = odd.union(odd).union(docs.limit(2)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    docs = docs.union(odd.select(*docs.columns)).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    docs = corpus_pipeline.kept_table(docs, "clashing")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name == "best_fit_packing":
            assert out.count() >= docs.count()
            continue
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in CLASHING), name
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0, name


def test_packing_stage_and_run(spark, stages):
    encoder = packing.UnitTokenizer(tokenizer_path())
    used, least = check_packing([(r.doc_id, r.text) for r in stages[4]], stages[5], encoder, 1024)
    assert used <= 1.05 * least + 3
    ran = corpus_pipeline.run(spark, SMALL).collect()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r[c] for c in columns) for r in ran) == sorted(tuple(r[c] for c in columns) for r in stages[5])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_its_sql(spark, name):
    ok, note = check.compare(spark, check.connect(SMALL), SMALL, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_queries_without_sql_return_every_row(spark):
    documents = table(spark, SMALL, "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: r for r in QUERIES["op5_suffix_dedup"](spark, SMALL).collect()}
    assert {k: tuple(v) for k, v in got.items()} == {w[0]: w[:5] for w in removed(rows, 50)}
    sets, group = brute(rows)
    want = {}
    for (i, _), own, g in zip(rows, sets, group):
        want[i] = (i, len(own), min(r[0] for r, h in zip(rows, group) if h == g) if own else i)
    assert {r.doc_id: tuple(r) for r in QUERIES["op3_jaccard_join"](spark, SMALL).collect()} == want
    for name in ("op4_toxicity", "op7_quality_rules", "op8_quality_classifier"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, SMALL).collect()) == sorted(i for i, _ in rows)
    packed = QUERIES["op9_best_fit_packing"](spark, SMALL).collect()
    check_packing(rows, packed, packing.UnitTokenizer(tokenizer_path()), 1024)
    pages = {r.page_id: r for r in table(spark, SMALL, "pages").collect()}
    for r in QUERIES["op6_html_extraction"](spark, SMALL).collect():
        assert r.n_chars == len(r.text) and pages[r.page_id].url == r.url and r.text
    assert hashlib.sha256(b"").hexdigest() in {r.kept_sha256 for r in got.values()}
