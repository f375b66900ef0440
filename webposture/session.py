"""Session helpers: the shared folder and intermediate tables."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for stream checkpoints and intermediate tables.

    On a cluster it is the one named in ``spark.checkpoint.dir``.  Only a local session,
    where driver and executors are one process, may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="webposture-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Tables that the innermost ``scratch`` has seen written.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _new_table(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def materialize(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder, with a folder for each value of ``parts``, and read it back.

    For frames that several later jobs read, or whose values (partition ids) must not change when a
    lost executor forces a stage to run again.  Unlike a checkpointed RDD the table is columnar and
    has a known size, so later joins can prune columns and choose their strategy.
    """
    spark = df.sparkSession
    path = _new_table(spark, uuid4().hex)
    (df.write.partitionBy(*parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_LEAN = {
    # Else shuffle files stay until the driver collects its garbage, which one with little to do seldom does.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Ids and URLs in order are packed by a factor of up to 300; the planner must not take a file of 5 MB for a table of 5 MB to broadcast.
    "spark.sql.sources.fileCompressionFactor": "100",
}


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Jobs that run meanwhile leave no shuffle files, and the tables they write are small.

    Yields the list of these tables, but for those of a ``scratch`` within; what nothing reads any more can be given to ``discard``.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        with settings(spark, _LEAN):
            yield made
    finally:
        _made.reset(token)


def discard(spark: SparkSession, tables: Iterable[str]) -> None:
    """Delete tables that ``scratch`` has seen written."""
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, task_rows: int) -> DataFrame:
    """The rows dealt out to tasks of about ``task_rows``.

    For narrow rows of few files that become many or wide ones: a file splits by its compressed size, not by the work
    that its rows make.
    """
    tasks = math.ceil(df.count() / task_rows)
    return df.repartition(tasks) if tasks > 1 else df


#: Rows that a task sorts or aggregates at once.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for ``rows``: the session's number, or as many as keep a task at ``TASK_ROWS``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """``values`` hold meanwhile."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles(spark: SparkSession, partitions: int):
    """What is written meanwhile shuffles into ``partitions``, so that a task's share does not grow with the input."""
    return settings(spark, {"spark.sql.shuffle.partitions": str(partitions)})


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Like ``materialize``, dealt into ``buckets`` by ``keys`` and sorted by them, so that joins on them read it without an exchange.

    Rows of a key are in one bucket, which a join cannot split.  The catalogue entry that bucketing takes is dropped again.
    """
    spark = df.sparkSession
    name = f"webposture_{uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", _new_table(spark, name)).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table
