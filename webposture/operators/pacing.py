"""Request pacing: the wait a per-domain token bucket imposes on each request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webposture import rules
from webposture.operators.ordering import before, with_rank


def check_rate(rate: float, period: float) -> None:
    if not (rate > 0 and period > 0):
        raise ValueError("rate and period must be greater than 0")


def token_bucket_wait(log: DataFrame, rate: float = rules.DEFAULT_RATE, period: float = 1.0) -> DataFrame:
    """Add ``wait`` (seconds) to ``log`` (domain, ts, seq).

    The bucket holds ``rate`` tokens and refills ``rate`` tokens per ``period`` seconds; every request
    takes one, also a waiting one, so the level may go negative.  With n requests before this
    one, the unclipped level falls by S = n - rate * (t - t_first) / period; the bucket is full
    wherever S is at a new minimum, so the shortage is S - min(S so far).

    Rank and minimum are computed per chunk and carried over (see ``ordering``): one domain may hold
    any share of the log.
    """
    check_rate(rate, period)
    key = ["domain"]
    # A URL without host belongs to the domain ''.
    domain = F.coalesce("domain", F.lit("")).alias("domain")
    log = log.select(domain, "ts", "seq", F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"))
    ranked = with_rank(log, key, ["__us", "seq"])
    elapsed = (F.col("__us") - F.col("first")) / F.lit(1e6)
    level = F.col("rank") - F.lit(float(rate)) * elapsed / F.lit(float(period))
    spent = ranked.select("domain", "ts", "seq", "__us", "chunk", level.alias("__s"))

    lows = spent.groupBy("domain", "chunk").agg(F.min("__s").alias("__low"))
    carried = lows.select(
        "domain", "chunk", before(F.col("__low"), key, F.min, F.lit(float("inf"))).alias("__carried")
    )
    so_far = Window.partitionBy("domain", "chunk").orderBy("__us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    low = F.least(F.min("__s").over(so_far), F.col("__carried"))
    shortage = F.col("__s") - low + F.lit(1.0 - float(rate))
    wait = F.greatest(F.lit(0.0), shortage / F.lit(float(rate)) * F.lit(float(period)))
    return spent.join(carried, ["domain", "chunk"]).withColumn("wait", wait).select("domain", "ts", "seq", "wait")
