"""Streaming deduplication of discovered URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.functions import urls as U


def dedupe_urls(urls: DataFrame, event_time: str | None = None, within: str = "1 day") -> DataFrame:
    """First sight of every (scan_id, url), fragments ignored.

    Without ``event_time`` every key is remembered, as a visited set does.  With it, keys may be
    forgotten after ``within``, which bounds the state but lets later repeats through.
    """
    keyed = urls.withColumn("url", U.strip_fragment(F.col("url")))
    if event_time is None:
        return keyed.dropDuplicates(["scan_id", "url"])
    keyed = keyed.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return keyed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["scan_id", "url"])
