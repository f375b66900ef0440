"""Streaming page scan: findings while responses still land, and running counts."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webposture import rules
from webposture.functions import urls as U
from webposture.operators.pages import scan_page
from webposture.operators.robots import robots_filter, robots_rules
from webposture.sources.sinks import finding_rows_sink


def stream_findings(responses: DataFrame, max_bytes: int | None = None, robots_files: DataFrame | None = None) -> DataFrame:
    """The page checks on a stream; they are stateless, so this is the batch plan.

    With ``robots_files``, a static table, only pages that their origin's rules allow have findings, under normalised URLs as
    in ``run_scans``.  The rules are joined with the findings, few and narrow rows, instead of with the pages, so no body is
    shuffled however many rules there are.
    """
    if robots_files is None:
        return scan_page(responses, max_bytes=max_bytes)
    parsed = U.normalized(responses, "url", "__url")
    pages = parsed.withColumn("url", U.strip_fragment(F.col("__url"))).drop("__url")
    return robots_filter(scan_page(pages, max_bytes=max_bytes), robots_rules(robots_files))


def running_summary(findings: DataFrame) -> DataFrame:
    """Severity counts per scan so far; for output mode update or complete."""
    return findings.groupBy("scan_id").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES],
    )


def start_scan_sink(
    responses: DataFrame, path: str, checkpoint: str, robots_files: Callable[[SparkSession], DataFrame] | None = None,
    max_bytes: int | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Scan a stream of responses and write findings-table rows, once per batch even after a restart.

    ``robots_files`` reads the robots files; it is called for every batch, so rules that arrive while the stream runs count from
    the next batch on.
    """
    query_id = md5(checkpoint.rstrip("/").encode()).hexdigest()
    write = finding_rows_sink(path, query_id)

    def scan(batch: DataFrame, batch_id: int) -> None:
        files = robots_files(batch.sparkSession) if robots_files else None
        write(stream_findings(batch, max_bytes, files), batch_id)

    writer = responses.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_findings_sink(findings: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write a stream of findings as findings-table rows, once per batch even after a restart."""
    query_id = md5(checkpoint.rstrip("/").encode()).hexdigest()
    writer = findings.writeStream.foreachBatch(finding_rows_sink(path, query_id)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
