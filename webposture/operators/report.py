"""Findings as reports: order, summary, scan metrics, export rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webposture import rules
from webposture.operators.findings import FIELDS, severity_rank, severity_tag
from webposture.operators.ordering import with_rank
from webposture.session import materialize, scratch, shuffles, tasks_for

_COLUMNS = ("scan_id", *FIELDS)
# Ties in severity are broken by place, so that reports are reproducible.
REPORT_ORDER = ("severity_rank", "url", "line_number", "title", "evidence", "finding_type")
TERMINAL_STATES = ("completed", "failed")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def for_scans(findings: DataFrame, domains: DataFrame) -> DataFrame:
    """Give per-domain findings (with ``domain``) to every scan of the domain (scan_id, domain)."""
    return findings.join(domains, "domain").select(*_COLUMNS)


def all_findings(*parts: DataFrame) -> DataFrame:
    """The findings of all checks in one table."""
    return reduce(DataFrame.unionByName, [p.select(*_COLUMNS) for p in parts])


def ranked_findings(findings: DataFrame) -> DataFrame:
    """With ``severity_rank`` and the short ``tag``; sort by ``REPORT_ORDER`` at the sink only."""
    severity = F.col("severity")
    return findings.withColumns({"severity_rank": severity_rank(severity), "tag": severity_tag(severity)})


def summary(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Findings per scan, in total and per severity; with ``scans``, clean scans count 0."""
    counts = findings.groupBy("scan_id").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in rules.SEVERITIES],
    )
    if scans is None:
        return counts
    names = ["total_findings", *rules.SEVERITIES]
    return scans.select("scan_id").distinct().join(counts, "scan_id", "left").select(
        "scan_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def crawl_log(plan: DataFrame, responses: DataFrame) -> DataFrame:
    """What became of every planned URL: (scan_id, url, depth, pos0, error, bytes, fetched_at).

    ``plan``: frontier with ``allowed``; ``responses``: after ``size_gate``.  URLs never collected are
    not fetched and do not appear; a blocked URL is an error without download.
    """
    fetched = responses.select("scan_id", "url", "error", "bytes", "fetched_at")
    joined = plan.join(fetched, ["scan_id", "url"], "left").filter(~F.col("allowed") | F.col("bytes").isNotNull())
    blocked = ~F.col("allowed")
    return joined.withColumns({
        "error": F.when(blocked, F.lit(rules.ROBOTS_BLOCKED)).otherwise(F.col("error")),
        "bytes": F.when(blocked, F.lit(0)).otherwise(F.col("bytes")).cast("bigint"),
    })


def scan_info(targets: DataFrame, log: DataFrame, frontier: DataFrame) -> DataFrame:
    """Metrics per scan.

    Every finished fetch is a crawled page, also a failed or blocked one.  Discovered URLs are the
    accepted links: depth 1 and more, so neither the seed nor the probes.
    """
    fetches = log.groupBy("scan_id").agg(
        F.min("fetched_at").alias("start"),
        F.max("fetched_at").alias("end"),
        F.count("*").alias("pages_crawled"),
        F.count("error").alias("errors"),
        F.sum("bytes").alias("bytes_downloaded"),
    )
    found = frontier.groupBy("scan_id").agg(F.count_if(F.col("depth") > 0).alias("urls_discovered"))
    zero = F.lit(0).cast("bigint")
    start, end = F.col("start").cast("timestamp"), F.col("end").cast("timestamp")
    return (
        targets.select("scan_id", F.col("target_url").alias("target"))
        .join(fetches, "scan_id", "left").join(found, "scan_id", "left")
        .select(
            "scan_id", "target",
            rfc3339(start).alias("start_time"),
            rfc3339(end).alias("end_time"),
            F.expr("(unix_micros(cast(`end` as timestamp)) - unix_micros(cast(start as timestamp))) div 1000000")
            .alias("duration_seconds"),
            *[F.coalesce(c, zero).alias(c) for c in ("pages_crawled", "urls_discovered", "errors", "bytes_downloaded")],
            downloaded_mb(F.coalesce("bytes_downloaded", zero)).alias("downloaded_mb"),
        )
    )


def downloaded_mb(size: Column) -> Column:
    return F.round(size / F.lit(1024.0 * 1024.0), 2)


def as_json(fields: tuple[str, ...] = FIELDS) -> Column:
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def finding_rows(findings: DataFrame) -> DataFrame:
    """Findings as rows of a findings table: the location is the URL, raw_data the whole finding."""
    return findings.select(
        "scan_id", "severity", F.col("finding_type").alias("type"), "title", "description",
        F.col("url").alias("location"), as_json().alias("raw_data"),
    )


def scan_status(events: DataFrame) -> DataFrame:
    """Latest status per scan; ``completed_at`` only on terminal states, so a restart clears it."""
    last = events.groupBy("scan_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "seq")).alias("last"))
    status = F.col("last.status")
    return last.select(
        "scan_id", status.alias("status"),
        F.when(status.isin(*TERMINAL_STATES), rfc3339(F.col("last.ts"))).alias("completed_at"),
    )


#: Findings up to which a scan is ranked in one task, together with others.
SCAN_ROWS = 25_000


def report_parts(info: DataFrame, counts: DataFrame, findings: DataFrame, part_rows: int = 10_000) -> DataFrame:
    """The nested report of every scan as (scan_id, part_no, report), findings in report order.

    ``report`` is a JSON text with scan_info, summary and findings.  A scan with more than
    ``part_rows`` findings has several parts, since one row must not hold an unbounded list.

    Findings are shuffled once, by scan, which serves their rank, their parts and the heads.  Those of scans with more than
    ``SCAN_ROWS`` go another way, on which a scan is cut into many tasks.
    """
    spark = findings.sparkSession
    info_fields = [c for c in info.columns if c not in ("scan_id", "downloaded_mb")]
    heads = info.join(counts, "scan_id").select(
        "scan_id",
        F.struct(*info_fields).alias("scan_info"),
        F.struct("total_findings", *rules.SEVERITIES).alias("summary"),
    )
    with scratch(spark):
        heads = materialize(heads)
        rows, most = heads.agg(F.sum("summary.total_findings"), F.max("summary.total_findings")).first()
        tasks = tasks_for(spark, rows or 0)
        large = None
        if (most or 0) > SCAN_ROWS:
            over = F.col("summary.total_findings") > SCAN_ROWS
            scans = materialize(heads.filter(over).select("scan_id").distinct())
            with shuffles(spark, tasks):
                ranked = with_rank(ranked_findings(findings.join(scans, "scan_id", "left_semi")), ["scan_id"], list(REPORT_ORDER))
            large = _reports_by_part(heads.filter(over), ranked, part_rows)
            heads, findings = heads.filter(~over), findings.join(scans, "scan_id", "left_anti")
    small = _reports_by_scan(heads, findings, part_rows, tasks)
    return small if large is None else small.unionByName(large)


def _listed(ranked: DataFrame, part_rows: int) -> DataFrame:
    """(scan_id, part_no, findings): the ranked findings as lists."""
    part = F.col("rank").cast("bigint")
    return ranked.withColumn("part_no", F.expr(f"rank div {int(part_rows)}").cast("int")).groupBy(
        "scan_id", "part_no"
    ).agg(F.transform(
        F.array_sort(F.collect_list(F.struct(part.alias("rank"), F.struct(*FIELDS).alias("finding")))),
        lambda f: f["finding"],
    ).alias("findings"))


def _last_part(part_rows: int) -> Column:
    return F.expr(f"greatest((summary.total_findings - 1) div {int(part_rows)}, 0)").cast("int")


def _report() -> list[Column]:
    listed = F.coalesce("findings", F.array()).alias("findings")
    nested = F.to_json(F.struct("scan_info", "summary", listed), {"ignoreNullFields": "false"})
    return [F.col("scan_id"), F.col("part_no"), nested.alias("report")]


def _reports_by_scan(heads: DataFrame, findings: DataFrame, part_rows: int, tasks: int) -> DataFrame:
    """Reports of scans whose findings fit a task."""
    dealt = ranked_findings(findings.repartition(tasks, "scan_id"))
    order = Window.partitionBy("scan_id").orderBy(*REPORT_ORDER)
    grouped = _listed(dealt.withColumn("rank", F.row_number().over(order) - 1), part_rows)
    joined = heads.repartition(tasks, "scan_id").hint("merge").join(grouped, "scan_id", "left")
    part = F.coalesce("part_no", F.lit(0))
    return joined.withColumn("part_no", part).filter(part <= _last_part(part_rows)).select(*_report())


def _reports_by_part(heads: DataFrame, ranked: DataFrame, part_rows: int) -> DataFrame:
    """Reports of scans of any size."""
    # One head per part: joined on the scan alone, all parts of a large scan would meet in one task.
    heads = heads.withColumn("part_no", F.explode(F.sequence(F.lit(0), _last_part(part_rows))))
    return heads.hint("merge").join(_listed(ranked, part_rows), ["scan_id", "part_no"], "left").select(*_report())
