"""Ranks and running values over groups of any size.

A window with ``partitionBy(key)`` sorts all rows of a key in one task, which a hot key overloads.
Here the rows are range-partitioned by (key, order), so a hot key spreads over many chunks; a
chunk's offset comes from the totals of the chunks before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webposture.session import materialize

def before(value: Column, keys: Sequence[str], combine, empty: Column) -> Column:
    """``combine`` of ``value`` over the earlier chunks of the same key; for per-chunk totals."""
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(combine(value).over(earlier), empty)


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``rank``, 0-based within ``keys`` by ``order`` (unique), ``chunk`` and ``first``.  Null keys are keys like others.

    ``first`` is the least value of the leading order column within ``keys``.  All rows of a
    (keys, chunk) pair fit one task, and chunks follow the order.  The sorted rows are written
    once: chunk numbers must not change if a stage runs again.
    """
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialize(ordered.withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("chunk", F.shiftright("__at", 33).cast("int"))  # the partition id
    totals = placed.groupBy(*keys, "chunk").agg(
        F.min("__at").alias("__start"), F.count("*").alias("__n"), F.min(order[0]).alias("first")
    )
    offsets = totals.select(
        *[F.col(k).alias(f"__{k}") for k in [*keys, "chunk"]],
        (F.col("__start") - before(F.col("__n"), keys, F.sum, F.lit(0))).alias("__zero"),
        F.min("first").over(Window.partitionBy(*keys)).alias("first"),
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("chunk") == F.col("__chunk"))
    ranked = placed.join(offsets, same)
    return ranked.withColumn("rank", F.col("__at") - F.col("__zero")).drop(
        "__at", "__zero", *[f"__{k}" for k in [*keys, "chunk"]]
    )
