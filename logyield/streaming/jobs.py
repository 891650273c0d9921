"""Arriving log files and runs: the batch jobs on micro-batches.

Both jobs write ordinary tables. A micro-batch replaces the partition named by
its id, so one that is repeated after a failure leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.yields import percent
from ..plans.parse import parse_logs, steps_table
from ..plans.parse_lines import parse_lines, read_log_lines
from ..schema import FAIL, PASS
from ..session import setting, stored, stream_session, temporary_tables
from ..sources import folders

LOG_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
DAY_SCHEMA = "date string, pass bigint, fail bigint, micro_batch bigint"
ADAPTIVE = "spark.sql.adaptive.enabled"


def _arriving(spark: SparkSession, root: str, max_files: int) -> DataFrame:
    files = (
        stream_session(spark).readStream.format("binaryFile")
        .schema(LOG_FILE_SCHEMA)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", folders.RUN_LOG_GLOB)
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    rel = folders.relative_path(F.col("path"), folders.qualified(spark, root))
    named = files.withColumns({"run_folder": folders.folder_of(rel), "file_name": folders.name_of(rel)})
    return named.filter(folders.is_run_log(F.col("file_name")))


def log_stream(spark: SparkSession, root: str, max_files: int = 10_000, row_bytes: int = folders.ROW_BYTES) -> DataFrame:
    """Run logs of every size appearing below ``root``, named but not opened, for :func:`ingest_runs`.

    run_folder, file_name, path, file_key, size, root; ``as_lines`` marks logs of
    ``row_bytes`` or more. At most ``max_files`` come in a micro-batch. The first log
    by name of each folder is kept as state: a later log of a folder is dropped unless
    its name comes first; then it takes the place of the earlier one.
    """
    # Of one micro-batch all rows have one time, so a folder's first log is new if it bears the time of this one.
    now = F.current_timestamp()
    arrived = _arriving(spark, root, max_files).select(
        "run_folder",
        "file_name",
        now.alias("at"),
        "path",
        F.col("_metadata.file_path").alias("file_key"),
        F.col("length").alias("size"),
    )
    first = F.min(F.struct("file_name", "at", "path", "file_key", "size")).alias("f")
    return arrived.groupBy("run_folder").agg(first).filter(F.col("f.at") == now).select(
        "run_folder",
        "f.file_name",
        "f.path",
        "f.file_key",
        "f.size",
        F.lit(root).alias("root"),
        (F.col("f.size") >= row_bytes).alias("as_lines"),
    )


def at_once(spark: SparkSession, *jobs: Callable) -> list:
    """Results of jobs that do not need each other: one on a few hundred logs leaves most cores idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        return [job.result() for job in running]


def parse_files(spark: SparkSession, files: list[Row]) -> tuple[DataFrame, DataFrame] | None:
    """Runs and steps of one micro-batch of :func:`log_stream`; None without logs.

    The paths, as many as the stream's ``max_files`` at most, were collected, so
    that only this batch's files are listed and read, each by the parser for its size.
    """
    jobs = []
    if whole := [f for f in files if not f["as_lines"]]:
        jobs.append(lambda: _whole(spark, whole))
    if large := [f for f in files if f["as_lines"]]:
        jobs.append(lambda: _large(spark, large))
    if not jobs:
        return None
    runs, steps = (reduce(DataFrame.unionByName, side) for side in zip(*at_once(spark, *jobs)))
    return runs, steps.select("unit_id", F.col("step_no").cast("long").alias("step_no"), "name", "result", "duration_s")


def _whole(spark: SparkSession, files: list[Row]) -> tuple[DataFrame, DataFrame]:
    # A log that has grown since it was listed is still read.
    logs = folders.read_logs(spark, files[0]["root"], 1 << 62, paths=[f["path"] for f in files])
    parsed = stored(parse_logs(logs), "parsed")
    return parsed.drop("steps"), steps_table(parsed)


def _large(spark: SparkSession, files: list[Row]) -> tuple[DataFrame, DataFrame]:
    chosen = spark.createDataFrame(
        [(f["file_key"], f["run_folder"], f["file_name"]) for f in files],
        "file_key string, run_folder string, file_name string",
    )
    runs, steps = parse_lines(read_log_lines(spark, files[0]["root"], paths=[f["path"] for f in files]), chosen)
    return runs.drop("steps"), steps.drop("run_folder")


def _replace_partition(path: str):
    def write(rows: DataFrame, micro_batch: int) -> None:
        rows.withColumn("micro_batch", F.lit(micro_batch)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("micro_batch").parquet(path)

    return write


def ingest_runs(logs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse each log of :func:`log_stream` once and append its run and steps; stops when the input is used up.

    Runs and steps are tables of their own below ``path``, so no row grows with a log. What a micro-batch stores on
    its way is removed with it. Read the result with :func:`ingested_runs` and :func:`ingested_steps`.
    """
    replace_runs, replace_steps = _replace_partition(f"{path}/runs"), _replace_partition(f"{path}/steps")

    adaptive = logs.sparkSession.conf.get(ADAPTIVE)

    def read_and_replace(arrived: DataFrame, micro_batch: int) -> None:
        spark, files = arrived.sparkSession, arrived.collect()
        # A stream with state switches adaptive plans off in its session; what follows are batch jobs on a few hundred logs.
        with temporary_tables(spark), setting(spark, ADAPTIVE, adaptive):
            parsed = parse_files(spark, files)
            if parsed is not None:
                runs, steps = parsed
                at_once(spark, lambda: replace_runs(runs, micro_batch), lambda: replace_steps(steps, micro_batch))

    return (
        logs.writeStream.outputMode("update")
        .foreachBatch(read_and_replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingested_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run of each folder: that of its first log by name, should a later micro-batch have brought it."""
    rows = spark.read.parquet(f"{path}/runs")
    first = rows.groupBy("unit_id").agg(F.min_by("micro_batch", F.col("source_files")[0]).alias("micro_batch"))
    return rows.join(first, ["unit_id", "micro_batch"], "left_semi")


def ingested_steps(spark: SparkSession, path: str) -> DataFrame:
    """The steps of :func:`ingested_runs`."""
    steps = spark.read.parquet(f"{path}/steps")
    current = ingested_runs(spark, path).select("unit_id", "micro_batch")
    return steps.join(current, ["unit_id", "micro_batch"], "left_semi").drop("micro_batch")


def day_of(at: Column) -> Column:
    """Calendar day in UTC."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(at) / 86400).cast("int"))


def daily_counts(runs: DataFrame, delay: str = "2 days") -> DataFrame:
    """Streaming PASS/FAIL counts per day of ``runs`` (start_time, result).

    Unlike the batch table, rows later than the watermark are dropped.
    """
    timed = (
        runs.filter(F.col("start_time").isNotNull() & F.col("result").isin(PASS, FAIL))
        # The wall clock is read as UTC, so days do not depend on the session's zone.
        .withColumn("at", F.to_timestamp(F.concat(F.col("start_time").cast("string"), F.lit("Z"))))
        .withWatermark("at", delay)
    )
    return (
        timed.groupBy(F.window("at", "1 day").alias("w"))
        .agg(F.count_if(F.col("result") == PASS).alias("pass"), F.count_if(F.col("result") == FAIL).alias("fail"))
        .select(day_of(F.col("w.start")).cast("string").alias("date"), "pass", "fail")
    )


def write_daily_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed days of every micro-batch; :func:`current_days` reads the latest."""
    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(_replace_partition(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_days(spark: SparkSession, path: str) -> DataFrame:
    """Latest counts per day with the yield, one row per day."""
    rows = spark.read.schema(DAY_SCHEMA).parquet(path)
    last = rows.groupBy("date").agg(F.max_by(F.struct("pass", "fail"), F.col("micro_batch")).alias("c"))
    return last.select("date", "c.*").withColumn("yield", percent(F.col("pass"), F.col("pass") + F.col("fail")))
