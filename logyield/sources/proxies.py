"""``runs`` tables derived from the driver's sample tables.

``runs`` reads ``events``; ``runs_large`` reads ``lineitem`` with its
dimensions. Both are plain projections (and look-ups), so their size follows
the tables. The SQL twins used as oracles live in ``logyield.queries.sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import failure_snippet
from ..operators.skew import salted_lookup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Deals a fixture's input to the shuffle partitions: a sample table is one file, and the work per row is heavy."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_from_events(table(spark, sf_dir, "events"))


def runs_from_events(events: DataFrame) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("long")
    failed = F.col("event_type") == "error"
    text = lambda c: c.cast("string")
    start = F.when(e % 101 != 0, F.col("ts"))
    return events.withColumn("k", k).select(
        text(e).alias("unit_id"),
        F.when(u % 29 != 0, F.concat(F.lit("SN"), text(u))).alias("serial_number"),
        F.concat(F.lit("P"), text(u % 5)).alias("product_code"),
        F.when(e % 7 != 0, F.concat(F.lit("LOT"), text(e % 6))).alias("lot_id"),
        F.concat(F.lit("OP"), text(u % 3)).alias("op_id"),
        text(e % 4).alias("station_id"),
        F.when(e % 11 != 0, F.concat(F.lit("H"), text(u % 3))).alias("host"),
        start.alias("start_time"),
        F.when(e % 13 != 0, F.col("ts") + F.make_dt_interval(secs=(e % 600).cast("decimal(18,6)"))).alias(
            "end_time"
        ),
        F.col("value").alias("duration_s"),
        F.when(failed, "FAIL").when(F.col("event_type") == "click", "UNKNOWN").otherwise("PASS").alias("result"),
        F.when(failed & (e % 17 != 0), F.concat(F.lit("E"), text(F.col("k") % 7))).alias("error_code"),
        F.when(failed & (e % 19 != 0), F.concat(F.lit("Limit "), text(F.col("k")), F.lit("  exceeded"))).alias(
            "error_message"
        ),
        F.when(failed, F.concat(F.lit("Step"), text(F.col("k") % 9))).alias("failing_step"),
        F.concat(F.lit("STC_WW"), text(u % 52), F.lit("___"), text(e)).alias("run_folder"),
        F.when(u % 4 == 0, "APSE").when(u % 4 == 1, "TESTAPP").alias("test_mode"),
        (e % 3 != 0).alias("has_done_block"),
        (F.col("value") * 8).alias("total_test_time_s"),
        "k",
    )


def runs_large(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """One run per order line, with the dimension columns that are asked for.

    ``wanted`` may name product_code, host and lot_id; the others stay null and
    their tables are not read. A part, supplier or order may own a large share
    of the lines, so the look-ups spread hot keys; none is broadcast unasked.
    """
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    spread_by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    if "product_code" in wanted:
        part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_code"))
        line = salted_lookup(line, part, ["l_partkey"], spread_by)
    if "host" in wanted:
        nation = t("nation").select("n_nationkey", F.col("n_name").alias("host"))
        supplier = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        station = salted_lookup(supplier, nation, ["n_nationkey"], ["l_suppkey"]).select("l_suppkey", "host")
        line = salted_lookup(line, station, ["l_suppkey"], spread_by)
    if "lot_id" in wanted:
        lots = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("lot_id"))
        line = salted_lookup(line, lots, ["l_orderkey"], spread_by)
    line = line.withColumns(
        {c: F.lit(None).cast("string") for c in ("product_code", "host", "lot_id") if c not in wanted}
    )
    flag = F.col("l_returnflag")
    failed = flag == "R"
    return line.select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")
        ).alias("unit_id"),
        F.col("l_partkey").cast("string").alias("serial_number"),
        "product_code",
        "lot_id",
        F.col("l_linenumber").cast("string").alias("op_id"),
        F.col("l_suppkey").cast("string").alias("station_id"),
        "host",
        F.col("l_shipdate").alias("start_time"),
        F.col("l_shipdate").alias("end_time"),
        F.col("l_quantity").alias("duration_s"),
        F.when(failed, "FAIL").when(flag == "A", "PASS").otherwise("UNKNOWN").alias("result"),
        F.when(failed, F.concat(F.lit("E"), (F.col("l_suppkey") % 13).cast("string"))).alias("error_code"),
        F.when(failed, F.concat(F.lit("limit "), F.col("l_quantity").cast("int").cast("string"), F.lit(" exceeded"))).alias(
            "error_message"
        ),
        F.lit(None).cast("string").alias("failing_step"),
        F.concat(F.lit("run"), F.col("l_orderkey").cast("string")).alias("run_folder"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``runs`` with the text columns a diagnosis reads (set on FAIL only)."""
    r = runs(spark, sf_dir)
    e = F.col("unit_id").cast("long")
    failed = F.col("result") == "FAIL"
    trace = F.concat_ws(
        " ",
        F.lit("trace of"),
        F.col("failing_step"),
        F.concat(F.lit("host="), F.coalesce("host", F.lit("none"))),
        F.concat(F.lit("10.0.0."), (e % 256).cast("string")),
        F.concat(F.lit("SerialNumber: "), F.coalesce("serial_number", F.lit("RMA1234567"))),
        F.concat(F.lit('said "k"='), F.col("k").cast("string")),
    )
    snippet = failure_snippet(F.col("result"), F.col("failing_step"), F.col("error_code"), F.col("error_message"))
    return r.withColumns(
        {
            "debug_excerpt": F.when(failed & (e % 5 == 0), trace).when(failed & (e % 5 == 1), F.lit("")),
            "ftrunner_snippet": F.when(e % 10 != 3, snippet),
        }
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with one line that every masking rule can hit."""
    d = F.col("doc_id")
    s = d.cast("string")
    line = F.concat(
        F.lit("\n\x1b[31mERR\x1b[0m psexec \\\\srv-"), s, F.lit(".lab -u sysc"), s, F.lit(" -p tr@nsf3r cmd\nTOKEN: a"), s,
        F.lit(" user=op"), s, F.lit(" hostname : h"), s, F.lit(" 00:1A:2b:3C:4d:5E at 10.250.0."), (d % 256).cast("string"),
        F.lit(" SerialNumber=SN"), s, F.lit(" code RMA"), (d + 1000000).cast("string"), F.lit(" [34mwarn[0m"),
    )
    documents = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", F.concat("text", line).alias("text"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(dealt(table(spark, sf_dir, "events"), "event_id"))


def logs_of(events: DataFrame) -> DataFrame:
    """Tester logs written from the runs of ``events``: one text per run.

    The layout varies with the id so that every parser branch is taken: colour
    codes, missing and doubled keys, verdict blocks or none, steps with and
    without an end marker, and both sources of start and end time.
    """
    e, result = F.col("e"), F.col("result")
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    colour = lambda code: F.when(e % 5 == 0, code).otherwise("")
    stamped = lambda when: F.date_format(when, "yyyy-MM-dd HH:mm:ss")
    tag = lambda begin, level="INF": line(F.col(begin), f" {level}]", colour("[0m"), " ")
    # Staged: what several lines share is a column of its own, made once a log.
    r = (
        runs_from_events(events)
        .withColumns({"e": F.col("unit_id").cast("long"), "explicit": logs_explicit()})
        .withColumn("at", F.coalesce("start_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
        .withColumn("ends", F.col("at") + F.make_dt_interval(secs=(e % 600).cast("decimal(18,6)")))
        .withColumns({f"{c}_begin": line(colour("\x1b[32m"), "[", stamped(F.col(c))) for c in ("at", "ends")})
        .withColumns({"at_tag": tag("at_begin"), "ends_tag": tag("ends_begin")})
    )
    at, ends, at_tag, ends_tag, explicit = (F.col(c) for c in ("at", "ends", "at_tag", "ends_tag", "explicit"))
    failed = result == "FAIL"
    two = lambda n: line(F.when(n.between(0, 9), "0").otherwise(""), n.cast("string"))
    mmss = lambda n: line("00:", two((n / 60).cast("int")), ":", two((n % 60).cast("int")))
    stamp14 = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    parts = [
        line(at_tag, "scan file content:"),
        at_tag,
        line("SERIALNUMBER = ", F.col("serial_number")),
        F.when(e % 6 == 0, "PRODUCTCODE=OLD"),
        line(F.when(e % 2 == 0, at_tag).otherwise(""), "PRODUCTCODE=", F.col("product_code")),
        line("OPID=", F.col("op_id")),
        line("STATIONID=", F.col("station_id")),
        line(F.when(e % 2 == 0, "Host=").otherwise("HOST="), F.col("host")),
        line("TPDIR_NAME=TP", (e % 3).cast("string")),
        line("TPDIR_VERSION=V", (e % 10).cast("string")),
        F.when(e % 8 == 0, "not a pair").otherwise(""),
        F.lit("SERIALNUMBER=IGNORED"),
        line("testmode: ", F.col("test_mode")),
        F.when(F.col("lot_id").isNotNull(), line("info; lotid=", F.col("lot_id"), F.lit(";rest"))),
        F.when(e % 4 != 0, line("Test start time: ", stamp14(at))),
        F.when(e % 10 == 7, line(at_tag, "starting HST_ET flow")),
        F.when(e % 9 != 8, line(at_tag, "***PowerTest test start.***")),
        F.when(e % 9 != 8, line(at_tag, F.when(e % 9 < 3, "TEST PASSED").otherwise("measured 3.3 V"))),
        F.when(e % 9 != 8, line(at_tag, "***PowerTest test end.***")),
        F.when(e % 9 != 8, line(at_tag, "Test time(hh\\mm\\ss): ", mmss(e % 3000))),
        line(at_tag, "**** Thermal Test test start.****"),
        F.when(failed, line(at_tag, "Copy to STC process failed.")),
        F.when(e % 2 == 0, line(at_tag, "***Thermal Test test end.***")),
        line(at_tag, "Test time(hh\\mm\\ss): 00:00:07"),
        F.when(failed & ~explicit, line(tag("at_begin", "ERR"), "station stopped")),
        F.when(e % 7 == 3, line("Test end time: ", stamp14(ends))),
        F.when(F.col("total_test_time_s").isNotNull(), line("Total Test time(s): ", F.format_string("%.2f", "total_test_time_s"))),
        line(ends_tag, "closing"),
        F.when(explicit, line(ends_tag, "done file content:")),
        F.when(explicit, ends_tag),
        F.when(explicit, line("Result=", F.when(result == "UNKNOWN", "ABORT").when(e % 2 == 0, F.lower(result)).otherwise(result))),
        F.when(explicit & (e % 3 == 1), line("EndTime=", stamp14(ends))),
        F.when(explicit, line("Errorcode=", F.col("error_code"))),
        F.when(explicit, line("ErrorMsg=", F.col("error_message"))),
    ]
    # concat_ws leaves null lines out and is compiled; array functions with lambdas are interpreted for every log.
    sep = F.when(e % 12 == 5, "\r\n").otherwise("\n")
    return r.select("run_folder", F.lit("ftrunnerlog01.txt").alias("file_name"), F.concat_ws("\n", *parts).alias("_t"), sep.alias("_sep")).select(
        "run_folder", "file_name", F.when(F.col("_sep") == "\n", F.col("_t")).otherwise(F.replace("_t", F.lit("\n"), F.lit("\r\n"))).alias("text")
    )


def logs_explicit():
    """Rendered runs with a verdict block: an unknown result cannot be told without one."""
    return F.col("has_done_block") | (F.col("result") == "UNKNOWN")
