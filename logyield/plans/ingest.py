"""A folder of tester logs and archives → runs with debug excerpts, their steps, and warnings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.excerpt import EXCERPT_BUDGET, with_debug_excerpt
from ..schema import FAIL
from ..sources import archives as zips
from ..sources import folders
from ..session import stored
from .parse import parse_logs, steps_table
from .parse_lines import parse_lines, read_log_lines, read_splits, splits_of


class Batch(NamedTuple):
    """``steps``: unit_id, step_no, name, result, duration_s — a table, as a log may have any number of steps."""

    runs: DataFrame
    steps: DataFrame
    warnings: DataFrame


def attach_debug_excerpts(runs: DataFrame, archives: DataFrame, budget: int = EXCERPT_BUDGET) -> DataFrame:
    """Add has_debuglog and debug_excerpt to failing runs.

    ``archives`` (run_folder, archive, path or content) is joined to the failing
    runs first, so no other archive is opened. Each debug log is cut to its
    excerpt in the task that read it; the first archive by name wins.
    """
    needles = ["error_code", "error_message", "failing_step"]
    failed = runs.filter(F.col("result") == FAIL).select("run_folder", *needles)
    found = zips.find_debug_logs(archives.join(failed, "run_folder"), keep=needles)
    cut = with_debug_excerpt(
        found, "text", F.col("error_code"), F.col("error_message"), F.col("failing_step"), budget
    ).select("run_folder", "archive", "debug_excerpt")
    first = cut.groupBy("run_folder").agg(
        F.min_by(F.struct("debug_excerpt"), F.col("archive")).alias("d"), F.lit(True).alias("has_debuglog")
    )
    return (
        runs.join(first, "run_folder", "left")
        .withColumns(
            {"has_debuglog": F.coalesce("has_debuglog", F.lit(False)), "debug_excerpt": F.col("d.debug_excerpt")}
        )
        .drop("d")
    )


def ingest_folder(
    spark: SparkSession, root: str, row_bytes: int = folders.ROW_BYTES, skip: tuple[str, ...] = ()
) -> Batch:
    """Runs, steps and warnings of the batch below ``root``, without folders named in ``skip``.

    The tree is listed once, in tasks, the log of each folder chosen from the list and
    only that opened, by path: the driver holds neither files nor folders.
    Logs of ``row_bytes`` or more are parsed as lines, all others as one row
    each; both give the same runs and steps.
    """
    in_tasks = folders.is_plain_folder(spark, root)
    files = folders.list_tree(spark, root, skip) if in_tasks else stored(folders.list_files(spark, root, skip=skip), "listing")
    chosen = stored(folders.first_logs(files), "chosen")
    at_once, as_lines = chosen.filter(F.col("size") < row_bytes), chosen.filter(F.col("size") >= row_bytes)
    if in_tasks:
        small = parse_logs(folders.read_texts(folders.dealt_files(at_once)))
    else:
        small = parse_logs(folders.read_logs(spark, root, row_bytes, skip).join(at_once, ["run_folder", "file_name"], "left_semi"))
    # Parsed rows feed the runs and the steps: written once, not parsed twice.
    parsed = stored(small, "parsed")
    runs, steps = parsed.drop("steps"), steps_table(parsed)
    if not as_lines.isEmpty():
        lines = read_splits(folders.dealt_files(splits_of(as_lines))) if in_tasks else read_log_lines(spark, root, row_bytes)
        large, more = parse_lines(lines, as_lines)
        runs = runs.unionByName(large.drop("steps"))
        steps = steps.unionByName(more.select(*[F.col(c).cast(t) for c, t in steps.dtypes]))
    archives = files.filter(F.lower("file_name").endswith(".zip")).select(
        "run_folder", F.col("file_name").alias("archive"), "path"
    )
    return Batch(attach_debug_excerpts(runs, archives), steps, incomplete(files))


def incomplete(files: DataFrame) -> DataFrame:
    """Warnings for folders without any log. Archives are listed only where no loose log settles it."""
    name = F.lower("file_name")
    settled = files.filter(folders.is_run_log(F.col("file_name")) | (name == folders.DEBUG_LOG)).select("run_folder")
    open_folders = files.join(settled, "run_folder", "left_anti")
    listed = open_folders.filter(name.endswith(".zip")).select(F.col("path").alias("archive"), "path")
    inside = (
        zips.list_members(listed)
        .filter(F.lower("member").endswith(folders.DEBUG_LOG))
        .select(F.col("archive").alias("path"), F.lit([folders.DEBUG_LOG]).alias("members"))
        .distinct()
    )
    return folders.incomplete_folders(open_folders.join(inside, "path", "left"))
