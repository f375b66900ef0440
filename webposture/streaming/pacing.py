"""Streaming token bucket: the wait of each request, with one bucket per domain as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from webposture import rules
from webposture.operators.ordering import before, with_rank
from webposture.operators.pacing import check_rate
from webposture.session import materialize

_OUTPUT = "domain string, ts timestamp, seq bigint, wait double"
_STATE = "tokens double, last_us bigint"


def stream_pacing(log: DataFrame, rate: float = rules.DEFAULT_RATE, period: float = 1.0) -> DataFrame:
    """Add ``wait`` to a stream of (domain, ts, seq).

    Requests of a micro-batch are taken in time order; one that is older than the last refill
    refills nothing.  The waits of a batch come from one vectorised pass per domain, so bound the
    batches of a busy source (``maxFilesPerTrigger``); ``start_pacing_sink`` has no such limit.
    """
    check_rate(rate, period)

    def take(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["us", "seq"], kind="stable")
        at = rows["us"].to_numpy()
        if state.exists:
            tokens, last = state.get
        else:
            tokens, last = float(rate), int(at[0])
        clock = np.maximum(at, last)
        taken = np.arange(len(at), dtype="float64")
        # Level before each request if nothing were clipped, then the overflow clipped so far.
        level = tokens + (clock - last) * (rate / period / 1e6) - taken
        overflow = np.maximum.accumulate(np.maximum(level - rate, 0.0))
        level -= overflow
        rows["wait"] = np.maximum((1.0 - level) / rate * period, 0.0)
        state.update((float(level[-1] - 1.0), int(clock[-1])))
        yield rows.assign(domain=key[0])[["domain", "ts", "seq", "wait"]]

    keyed = log.select("domain", F.col("ts").cast("timestamp").alias("ts"), "seq").withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("domain").applyInPandasWithState(
        take, _OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout
    )


def start_pacing_sink(
    log: DataFrame, path: str, checkpoint: str, rate: float = rules.DEFAULT_RATE, period: float = 1.0, available_now: bool = False,
) -> StreamingQuery:
    """Write (domain, ts, seq, wait) of a stream to ``path``/waits, one folder per batch.

    Waits are those of ``stream_pacing``; a null domain is ''.  A batch's requests are ranked in chunks, so a domain may
    hold any share of it.  The buckets after a batch (domain, tokens, last_us) are a table in ``path``/buckets that the
    next one joins, and a batch that is run again writes the same folders.
    """
    check_rate(rate, period)

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = spark.createDataFrame([], "domain string, tokens double, last_us bigint")
        if batch_id:
            old = spark.read.schema(old.schema).parquet(f"{path}/buckets/batch={batch_id - 1}")
        domain = F.coalesce("domain", F.lit("")).alias("domain")
        rows = batch.select(domain, F.col("ts").cast("timestamp").alias("ts"), "seq").withColumn("us", F.unix_micros("ts"))
        ranked = materialize(with_rank(rows, ["domain"], ["us", "seq"]))
        # The old buckets come by chunk: a join on the domain alone would put all its rows into one task.
        held = ranked.select("domain", "chunk").distinct().join(old, "domain", "left")
        ranked = ranked.join(held, ["domain", "chunk"])
        last, tokens = F.coalesce("last_us", "first"), F.coalesce("tokens", F.lit(float(rate)))
        clock = F.greatest("us", last)
        ranked = ranked.select(
            "domain", "ts", "seq", "us", "chunk", "rank", tokens.alias("tokens"), clock.alias("clock"),
            (F.col("rank") - (clock - last) * F.lit(rate / period / 1e6)).alias("spent"),
        )
        lows = ranked.groupBy("domain", "chunk").agg(F.min("spent").alias("low"))
        carried = lows.select("domain", "chunk", before(F.col("low"), ["domain"], F.min, F.lit(float("inf"))).alias("carried"))
        so_far = Window.partitionBy("domain", "chunk").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
        low = F.least(F.min("spent").over(so_far), F.col("carried"))
        # Level before each request if nothing were clipped, less the overflow clipped so far.
        level = F.col("tokens") - F.col("spent") - F.greatest(F.lit(0.0), F.col("tokens") - low - F.lit(float(rate)))
        done = materialize(ranked.join(carried, ["domain", "chunk"]).withColumn("level", level))
        wait = F.greatest(F.lit(0.0), (1.0 - F.col("level")) / F.lit(float(rate)) * F.lit(float(period)))
        done.select("domain", "ts", "seq", wait.alias("wait")).write.mode("overwrite").parquet(f"{path}/waits/batch={batch_id}")
        new = done.groupBy("domain").agg((F.max_by("level", "rank") - 1.0).alias("tokens"), F.max("clock").alias("last_us"))
        kept = old.join(new, "domain", "left_anti").unionByName(new)
        kept.write.mode("overwrite").parquet(f"{path}/buckets/batch={batch_id}")

    writer = log.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
