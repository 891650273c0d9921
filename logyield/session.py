"""Session settings shared by tests, the benchmark and jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str = "local[*]", shuffle_partitions: int = 8, app: str = "logyield", shared: str | None = None
) -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own. ``shared`` names the shared folder."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    return (builder.config("spark.checkpoint.dir", shared) if shared else builder).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, so that all see the driver's disk, a folder of the driver's
    serves until its process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    path = tempfile.mkdtemp(prefix=f"logyield-{application}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block; the one before comes back."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders or files are listed in as many tasks as there are of them, up to this setting.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def listing_tasks(spark: SparkSession) -> str:
    """A few tasks a core, where one for every folder or file would take longer to start than to run."""
    return str(min(int(spark.conf.get(LISTING_TASKS)), 4 * spark.sparkContext.defaultParallelism))


def listing(spark: SparkSession):
    """For the time of a block, large trees are listed in :func:`listing_tasks`."""
    return setting(spark, LISTING_TASKS, listing_tasks(spark))


def stream_session(spark: SparkSession) -> SparkSession:
    """A session with the same settings for one stream, which lists files and keeps state in few tasks.

    A file source lists by the settings of the session that made it, for as long as the stream runs. A state of small
    rows has one partition a core: each is a task and a written file in every micro-batch.
    """
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set(LISTING_TASKS, listing_tasks(spark))
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


_written: dict[str, list[str]] = {}


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused location below the shared folder, owned by this application until :func:`release`."""
    path = f"{shared_dir(spark)}/logyield/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def remove_table(spark: SparkSession, path: str) -> None:
    """Removes one stored table once its last reader is done."""
    _written[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are removed at the end: for jobs that repeat and leave their results elsewhere."""
    mine = _written.setdefault(spark.sparkContext.applicationId, [])
    before = set(mine)
    try:
        yield
    finally:
        for path in [p for p in mine if p not in before]:
            remove_table(spark, path)


def release(spark: SparkSession) -> int:
    """Removes every table that this application has stored; call it once no result is read any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    Cuts the lineage and keeps costly columns from being computed again by each
    branch that reads them; the table outlives lost executors.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table
