"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_local_dir: str | None = None


def build_session(app: str = "colonnade", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    Adaptive execution picks join strategies, coalesces small shuffle partitions
    and splits skewed ones; the time zone is fixed so event times are the same
    wherever the job runs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local-master session may go without the setting; it then gets a fresh
    temporary folder, because there the driver's disk *is* the shared disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="colonnade-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: What a job shuffled goes as soon as it has ended; without it the files stay until the driver collects garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The plan runs once, the copy outlives lost executors, and readers get column
    pruning and file sizes for planning.  What the plan shuffled is not asked for again.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    with settings(df.sparkSession, SHUFFLES_GO):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled, none is sent through the driver.

    The planner knows a written table by its compressed files and does not count what
    ``explode`` adds, so it takes such a side for small enough to broadcast.
    """
    return side.hint("merge")


#: Rows that a task is given where they are few bytes each.
TASK_ROWS = 1 << 20


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for ``rows`` narrow rows, never fewer than any shuffle of the session has, so that a join keeps them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def spread(written: DataFrame, *keys: str) -> DataFrame:
    """A written table dealt out by ``keys`` to tasks of a bounded number of rows.

    Adaptive execution joins partitions by their compressed bytes, which for narrow rows in
    order are so few that one task gets ten million of them and sorts them at once.
    """
    return written.repartition(tasks_for(written.sparkSession, written.count()), *keys)
