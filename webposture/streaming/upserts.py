"""A keyed table that a stream keeps current: only changed keys are written, and never twice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

#: Partition columns of the table: whether a batch's folder holds all keys, and the batch.
_WHOLE, _BATCH = "__whole", "__batch"


def _folder(path: str, whole: bool, batch_id: int) -> str:
    return f"{path}/{_WHOLE}={str(whole).lower()}/{_BATCH}={batch_id}"


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], before: int | None = None) -> DataFrame:
    """The table as it stands (or stood before a batch): the latest row of every key.  A null key is a key like others."""
    columns = T.StructType([*schema.fields, T.StructField(_WHOLE, T.BooleanType()), T.StructField(_BATCH, T.LongType())])
    written = spark.read.schema(columns).parquet(path)
    if before is not None:
        written = written.filter(F.col(_BATCH) < before)
    # Folders before the last compaction are not read.
    base = written.filter(_WHOLE).agg(F.max(_BATCH)).first()[0]
    if base is not None:
        written = written.filter(F.col(_BATCH) >= base)
    others = [n for n in schema.names if n not in keys]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*others), _BATCH).alias("__last"))
    return last.select(*keys, "__last.*").select(*schema.names)


def upsert_sink(path: str, schema: T.StructType, keys: Sequence[str], compact_every: int = 20):
    """A ``foreachBatch`` function that merges rows with distinct ``keys`` into the table below ``path``.

    A batch owns a folder with its changed keys; every ``compact_every``-th writes all keys instead, merged with what was there
    before it.  So a batch that runs again writes what it wrote, and later batches win over earlier ones.  Old folders are
    left for the operator of the cluster to expire once a later one holds all keys.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        whole = (batch_id + 1) % compact_every == 0
        rows = batch.select(*schema.names)
        if whole:
            old = read_upserts(batch.sparkSession, path, schema, keys, batch_id)
            new = rows.select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
            rows = old.join(new, same, "left_anti").unionByName(rows)
        rows.write.mode("overwrite").parquet(_folder(path, whole, batch_id))

    return put


def start_upsert_sink(
    changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], compact_every: int = 20, available_now: bool = False,
) -> StreamingQuery:
    """Keep the table below ``path`` at what an aggregation in update mode says; ``read_upserts`` reads it, at any time."""
    changes.sparkSession.createDataFrame([], changes.schema).write.mode("overwrite").parquet(_folder(path, False, -1))
    sink = upsert_sink(path, changes.schema, keys, compact_every)
    writer = changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
