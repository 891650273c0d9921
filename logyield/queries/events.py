"""Client events derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import client_events as ce
from ..sources import proxies
from .registry import query

# Raw level, message and nested context of each event.
CLIENT = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
client AS (SELECT event_id, ts, k, user_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'Debug' WHEN 'click' THEN 'warning'
    WHEN 'signup' THEN 'verbose' ELSE NULL END AS level, CASE WHEN event_id % 10 = 0 THEN '' ELSE ' page_' || event_type || '_seen ' END AS message,
    CASE WHEN event_id % 25 = 0 THEN repeat('ab ', 400) ELSE 'n' || k END AS note FROM ev)"""


def client(spark, sf_dir):
    e = F.col("event_id")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    raw_level = (
        F.when(kind == "error", "ERROR").when(kind == "view", "Debug").when(kind == "click", "warning").when(kind == "signup", "verbose")
    )
    note = F.when(e % 25 == 0, F.repeat(F.lit("ab "), F.lit(400))).otherwise(F.concat(F.lit("n"), k.cast("string")))
    nested = F.struct(
        F.struct(F.struct(F.struct(k.alias("d"), F.lit("x").alias("my_secret")).alias("c")).alias("b")).alias("a"),
        F.lit("hush").alias("Password"),
    )
    context = F.to_json(
        F.struct(
            k.alias("zeta"),
            F.concat(F.lit("t-"), e.cast("string")).alias("authToken"),
            nested.alias("nested"),
            F.sequence(F.lit(1).cast("long"), k + 1).alias("items"),
            (e % 2 == 0).alias("flag"),
            note.alias("note"),
            F.lit('say "hi"\n').alias("quote"),
            F.array(F.struct(F.lit("z").alias("apikey"), k.alias("v"))).alias("list"),
            (e / 2).alias("half"),
        )
    )
    return proxies.dealt(proxies.table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        "ts",
        raw_level.alias("level"),
        F.when(e % 10 == 0, "").otherwise(F.concat(F.lit(" page_"), kind, F.lit("_seen "))).alias("message"),
        context.alias("context"),
    )


LEVEL = "CASE WHEN lower(level) IN ('debug', 'info', 'warning', 'error') THEN lower(level) ELSE 'info' END"
MESSAGE = (
    "CASE WHEN message = '' THEN 'Frontend event' ELSE upper(left(trim(replace(message, '_', ' ')), 1)) ||"
    " substr(trim(replace(message, '_', ' ')), 2) END"
)
HALF = "CAST(event_id / 2 AS DOUBLE)"
SCRUBBED = (
    "'{\"zeta\":' || k || ',\"authToken\":\"[REDACTED]\",\"nested\":{\"a\":{\"b\":{\"c\":\"[MAX]\"}},\"Password\":\"[REDACTED]\"},\"items\":[' ||"
    " array_to_string(range(1, least(k + 2, 51)), ',') || '],\"flag\":' || CAST(event_id % 2 = 0 AS VARCHAR) || ',\"note\":\"' || note ||"
    " '\",\"quote\":\"say \\\"hi\\\"\\n\",\"list\":[{\"apikey\":\"[REDACTED]\",\"v\":' || k || '}],\"half\":' || CAST(" + HALF + " AS VARCHAR) || '}'"
).replace('{\\"c\\":\\"[MAX]\\"}', "").replace(
    '{\"c\":\"[MAX]\"}', "{\"c\":{\"d\":\"[MAX_DEPTH]\",\"my_secret\":\"[REDACTED]\"}}"
)
TRIMMED = f"""{CLIENT}, s AS (SELECT *, {SCRUBBED} AS scrubbed FROM client),
t AS (SELECT *, length(scrubbed) > 1000 AS cut FROM s)"""
SHORT_NOTE = "CASE WHEN length(note) > 120 THEN left(note, 117) || '...' ELSE note END"
DETAILS = (
    "CASE WHEN cut THEN 'details=' || left(left(scrubbed, 1000), 117) || '...' ELSE 'zeta=' || k ||"
    " ', authToken=[REDACTED], nested.a.b.c.d=[MAX_DEPTH], nested.a.b.c.my_secret=[REDACTED], nested.Password=[REDACTED], items=[' ||"
    " least(k + 1, 50) || ' items], +5 more' END"
)


@query("client_levels", f"WITH {CLIENT} SELECT event_id, {LEVEL} AS level FROM client WHERE {LEVEL} <> 'debug'")
def client_levels(spark, sf_dir):
    return ce.normalize_events(client(spark, sf_dir)).select("event_id", "level")


@query("client_messages", f"WITH {CLIENT} SELECT event_id, {MESSAGE} AS message FROM client")
def client_messages(spark, sf_dir):
    return client(spark, sf_dir).select("event_id", ce.message(F.col("message")).alias("message"))


@query("client_scrub", f"WITH {TRIMMED} SELECT event_id, scrubbed AS context FROM t")
def client_scrub(spark, sf_dir):
    return client(spark, sf_dir).select("event_id", ce.scrubbed(F.col("context")).alias("context"))


@query(
    "client_trim",
    f"""WITH {TRIMMED} SELECT event_id, CASE WHEN cut THEN '{{"details":"' ||
    replace(replace(left(scrubbed, 1000), '\\', '\\\\'), '"', '\\"') || '..."}}' ELSE scrubbed END AS context FROM t""",
)
def client_trim(spark, sf_dir):
    # A column of its own: written into the limit's conditions, the walk would be taken for each of them.
    scrubbed = client(spark, sf_dir).select("event_id", ce.scrubbed(F.col("context")).alias("context"))
    return scrubbed.select("event_id", ce.trimmed(F.col("context")).alias("context"))


# The sender also cuts long texts.
CLIENT_SCRUBBED = SCRUBBED.replace("|| note ||", "|| CASE WHEN length(note) > 500 THEN left(note, 500) || '...[truncated]' ELSE note END ||")


@query("client_client_side_scrub", f"WITH {CLIENT} SELECT event_id, {CLIENT_SCRUBBED} AS context FROM client")
def client_client_side_scrub(spark, sf_dir):
    return client(spark, sf_dir).select("event_id", ce.scrubbed(F.col("context"), client=True).alias("context"))


@query(
    "client_lines",
    f"""WITH {TRIMMED} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') || ' | ' || rpad(upper({LEVEL}), 7, ' ') || ' | ' ||
    {MESSAGE} || ' (' || {DETAILS} || ')' AS line FROM t WHERE {LEVEL} <> 'debug'""",
)
def client_lines(spark, sf_dir):
    return ce.normalize_events(client(spark, sf_dir)).select("event_id", ce.event_line(F.col("ts")).alias("line"))
