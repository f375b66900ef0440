"""Spark helpers of the operators: bounded broadcasts and heads of count tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a narrow table (two or three numbers) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 500_000


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most ``most`` rows; else Spark joins it by shuffles.

    The table should be written already: it is counted.
    """
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def count_floor(counts: DataFrame, count: str, most: int) -> int:
    """The least count so that at most ``most`` rows reach it; 1 if all rows fit.

    The rows are counted by size class (eight to an octave), so only a few hundred numbers reach the driver.
    """
    size_class = F.floor(F.log2(F.col(count)) * 8)
    found = counts.groupBy(size_class.alias("size")).agg(F.count("*").alias("n"), F.min(count).alias("least")).collect()
    total, floor = 0, None
    for row in sorted(found, key=lambda r: -r["size"]):
        total += row["n"]
        if total > most:
            break
        floor = row["least"]
    return int(floor) if floor is not None else 2**62


def blocks_for(rows: int, most: int) -> int:
    return max(1, math.ceil(rows / most))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that are none of the columns'."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out
