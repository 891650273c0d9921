"""The registered queries of this package: thin forms of the operators with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, decontaminate, html, jaccard, packing, quality, repair, rules, suffix, toxicity, urls, warc, whitening
from .common import table
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack(documents, tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


#: host, path, verdict of the rules asked for.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

OP10_SQL = r"""
WITH judged AS (
  SELECT page_id, url, row_number() OVER () AS n,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hits AS (
  SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM judged JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged LEFT JOIN hits USING (n)
"""


@query("op10_url_rules", OP10_SQL)
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, urls.RULE_SCHEMA)
    return urls.judge(table(spark, sf_dir, "pages"), rules)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP1_SQL = r"""
WITH tokens AS (
  SELECT doc_id, row_number() OVER () AS n, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_tokens AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item_tokens WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM wanted),
grams AS (
  SELECT n, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM (SELECT n, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM tokens, sizes WHERE len(w) >= size)),
hits AS (SELECT n, i, item_id, size FROM grams JOIN wanted USING (size, gram)),
hit_words AS (
  SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(i, i + size)) AS p FROM hits) GROUP BY n),
hit_items AS (
  SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN hit_words USING (n) LEFT JOIN hit_items USING (n)
"""


@query("op1_benchmark_decontamination", OP1_SQL)
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.report(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    CAST(unhex(sha1(coalesce(html, ''))) AS BIT)::VARCHAR AS bits FROM pages),
digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda g: substr(
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(5), lambda b:
        CAST(substr(bits, CAST(5 * g + b + 1 AS INTEGER), 1) AS INTEGER) * CAST(power(2, 4 - b) AS INTEGER))) AS INTEGER), 1)), '')
    AS payload_digest FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM digests)
"""


@query("op2_warc_round_trip", OP2_SQL)
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, weights=html.fit(pages))


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"struct_pack(c := CAST({state}.c + {cost} AS BIGINT), t := {state}.t || '{letter}', o := {state}.o || {line})"


def _only_if(condition: str, entry: str) -> str:
    return f"CASE WHEN {condition} THEN {entry} ELSE struct_pack(c := CAST(1e12 AS BIGINT), t := '', o := '') END"


def _repair_step() -> tuple[str, str]:
    """(insertions, edit of a row): the states z, s, u, v (nothing yet, after s, after u, after a) before → after."""
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    inserts = (
        "struct_pack(z := {a}.z, s := {a}.s, u := list_min([{a}.u, "
        + ", ".join(_edit("{a}." + x, "2", "I", user) for x in "zsv") + "]), v := {a}.v)"
    )
    closed = "struct_pack(z := b.z, s := b.s, u := b.u, v := list_min([b.v, " + _edit("b.u", "2", "I", assistant) + "]))"
    inserted = f"list_transform([{inserts}], lambda b: {closed})[1]"
    keep = "chr(10) || x.role || ':' || x.text"
    late = "CASE WHEN x.fault = 't' THEN 1 ELSE 0 END"
    may = "x.fault NOT IN ('b', 'd')"
    after = {
        "z": ["d.z"], "s": ["d.s", _only_if(f"{may} AND x.i = 's'", _edit("d.z", late, "K", keep))],
        "u": ["d.u"], "v": ["d.v"],
    }
    for before, now, initial, line in [*((b, "u", "u", user) for b in "zsv"), ("u", "v", "a", assistant)]:
        after[now].append(_only_if(f"{may} AND x.i = '{initial}'", _edit("d." + before, late, "K", keep)))
        after[now].append(_only_if(may, _edit("d." + before, f"2 + {late}", "R", f"{line} || x.text")))
    states = []
    for state, entries in after.items():
        deleted = _edit(entries[0], "3", "D")
        states.append(f"{state} := list_min([{', '.join([deleted, *entries[1:]])}])")
    return inserted, f"struct_pack({', '.join(states)})"


def _op12_sql() -> str:
    inserted, edited = _repair_step()
    step = f"list_transform([{inserted.format(a='a')}], lambda d: {edited})[1]"
    never = "struct_pack(c := CAST(1e12 AS BIGINT), t := '', o := '')"
    begin = f"struct_pack(z := struct_pack(c := CAST(0 AS BIGINT), t := '', o := ''), s := {never}, u := {never}, v := {never})"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH shown AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
dealt AS (
  SELECT *, xor(list_reduce(list_transform(range(length(k)), lambda i: CAST(ord(substr(k, CAST(i + 1 AS INTEGER), 1)) AS BIGINT)),
    lambda crc, byte: list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(crc, byte)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS h FROM shown),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE h <> 0),
placed AS (
  SELECT *, substr(role, 1, 1) AS i, rtrim(text, {blanks}) AS solid,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM damaged),
judged AS (
  SELECT *, CASE WHEN solid = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(solid, 1) IN ('.', '!', '?') THEN '' ELSE 't' END AS fault,
    lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (n > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list(struct_pack(role := role, text := text, i := i, fault := fault) ORDER BY n), lambda a, x: {step}, {begin}) AS a
  FROM judged GROUP BY conv_id),
ended AS (SELECT * EXCLUDE a, {inserted.format(a="a")} AS a FROM found),
best AS (SELECT *, list_min([a.z, a.v]) AS e FROM ended)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0) AS cost, coalesce(e.t, '') AS audit,
  sha256(coalesce(substr(e.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k LEFT JOIN best ON k.conv_id IS NOT DISTINCT FROM best.conv_id
"""


@query("op12_conversation_repair", _op12_sql())
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op11_minhash_near_dedup")
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"))
