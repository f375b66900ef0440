"""The whole job: from collected tables to a report, for many scans at once."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture import rules
from webposture.functions import urls as U
from webposture.operators import ct, dns, frontier, links, pages, report, robots, tls
from webposture.session import discard, materialize, scratch, shuffles, spread, tasks_for


@dataclass(frozen=True)
class ScanOptions:
    """What a caller can set; fixed default values."""

    depth: int = rules.DEFAULT_DEPTH
    ignore_robots: bool = False
    cross_domain: bool = False
    max_response_bytes: int | None = None
    max_subdomains: int | None = None


@dataclass(frozen=True)
class ScanReport:
    scan_info: DataFrame
    summary: DataFrame
    findings: DataFrame


@dataclass(frozen=True)
class Collected:
    """Input tables (schemas in ``webposture.schemas``); ``None`` leaves a check out."""

    targets: DataFrame
    responses: DataFrame
    robots_files: DataFrame | None = None
    dns_records: DataFrame | None = None
    tls_observations: DataFrame | None = None
    ct_entries: DataFrame | None = None


def target_domains(targets: DataFrame) -> DataFrame:
    """(scan_id, domain) of the targets."""
    return frontier.seeds(targets).select("scan_id", U.host_of(F.col("url")).alias("domain"))


def gated_responses(data: Collected, options: ScanOptions) -> DataFrame:
    """The responses with normalised URLs, without fragments; those without an http(s) URL are in ``unreadable_responses``."""
    gated = pages.size_gate(data.responses, options.max_response_bytes)
    parsed = U.normalized(gated, "url", "__url")
    return parsed.withColumn("url", U.strip_fragment(F.col("__url"))).drop("__url")


def first_fetches(fetches: DataFrame) -> DataFrame:
    """One row per page: the first by ``fetched_at``; of several at that time the one without error, then the smallest.

    Only for narrow tables: the rows are shuffled.
    """
    kept = [c for c in fetches.columns if c not in ("scan_id", "url")]
    order = F.struct(F.col("fetched_at").isNull(), "fetched_at", F.col("error").isNotNull(), "error", "bytes")
    first = fetches.groupBy("scan_id", "url").agg(F.min_by(F.struct(*kept), order).alias("__first"))
    return first.select("scan_id", "url", "__first.*").select(*fetches.columns)


def unreadable_responses(responses: DataFrame) -> DataFrame:
    """(scan_id, url, n): responses that no scan can use, since their URL is no valid http(s) URL."""
    parsed = U.with_url_parts(responses.select("scan_id", "url"), "url")
    return parsed.filter("parts IS NULL").groupBy("scan_id", "url").agg(F.count("*").alias("n"))


#: Targets that a task makes probes of.
TARGETS_A_TASK = 10_000

#: Targets, probes and responses of the scans that are crawled at once.
GROUP_ROWS = 30_000_000


def _rows(data: Collected) -> int:
    with scratch(data.targets.sparkSession):
        return data.responses.count()


def _fetches(data: Collected, options: ScanOptions) -> DataFrame:
    """What is needed of every response, links and size, so that the bodies are read once for all of it; not shuffled yet."""
    gated = gated_responses(data, options)
    return links.page_hrefs(gated).select("scan_id", "url", "error", "bytes", "fetched_at", "hrefs")


def _rules(data: Collected, options: ScanOptions) -> DataFrame | None:
    respect = data.robots_files is not None and not options.ignore_robots
    return robots.robots_rules(data.robots_files) if respect else None


def _plan(targets: DataFrame, fetches: DataFrame, rule_table: DataFrame | None, options: ScanOptions) -> DataFrame:
    """Frontier of the targets with ``allowed``."""
    linked = fetches.filter("size(hrefs) > 0").select("scan_id", "url", "hrefs")
    most_links = linked.agg(F.sum(F.size("hrefs"))).first()[0] or 0
    # Decided per page, before its links are rows.
    readable = robots.robots_filter(linked, rule_table) if rule_table is not None else linked
    # Repeats within a page go first: its links are dealt out before they are merged.
    found = links.resolve_links(links.links_of(readable.withColumn("hrefs", F.array_distinct("hrefs"))))
    # A target becomes as many rows as there are paths: spread before that.
    targets = spread(targets.select("scan_id", "target_url"), TARGETS_A_TASK)
    start = frontier.seeds(targets).unionByName(frontier.seed_probes(targets))
    reached = frontier.crawl_frontier(start, found, options.depth, options.cross_domain, False, most_links)
    return frontier.crawl_plan(reached, rule_table) if rule_table is not None else reached.withColumn("allowed", F.lit(True))


def crawl(data: Collected, options: ScanOptions = ScanOptions()) -> tuple[DataFrame, DataFrame]:
    """(frontier with ``allowed``, fetches): which URLs the crawls of ``data`` reach.

    Links count only from pages that a crawler would have read: allowed by robots rules and not
    failed or too large.
    """
    spark = data.targets.sparkSession
    with scratch(spark):
        with shuffles(spark, tasks_for(spark, _rows(data))):
            fetches = materialize(first_fetches(_fetches(data, options)))
        return _plan(data.targets, fetches, _rules(data, options), options), fetches


def _group(groups: int) -> Column:
    """The group of a scan."""
    return F.pmod(F.xxhash64("scan_id"), F.lit(groups)).cast("int")


def _crawl_groups(data: Collected, options: ScanOptions, responses: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """(scan_info, visited pages that were collected, the tables of these pages).

    Links, levels and plans take several times the disk of what is left of them.  They are made for one group of scans after the
    other and deleted again, so that there are never more of them than ``GROUP_ROWS`` make, unless a single scan has more.
    """
    spark = data.targets.sparkSession
    with scratch(spark) as shared:
        groups = max(1, math.ceil((responses + data.targets.count() * (1 + len(rules.SENSITIVE_PATHS))) / GROUP_ROWS))
        # Not shuffled yet: as files they take a third of that.
        collected = materialize(_fetches(data, options).withColumn("__group", _group(groups)), "__group")
        rule_table = _rules(data, options)
        rule_table = rule_table if rule_table is None else materialize(rule_table)
    infos, visited, pages_of = [], [], []
    for k in range(groups):
        targets = data.targets.filter(_group(groups) == k)
        with scratch(spark) as made:
            fetches = materialize(first_fetches(collected.filter(F.col("__group") == k).drop("__group")))
            with scratch(spark) as levels:
                plan = _plan(targets, fetches, rule_table, options)
            plan = materialize(plan)
            discard(spark, levels)
            log = materialize(report.crawl_log(plan, fetches))
        infos.append(materialize(report.scan_info(frontier.normalize_targets(targets), log, plan)))
        with scratch(spark) as tables:
            visited.append(materialize(log.filter("allowed").select("scan_id", "url")))
        discard(spark, made)
        pages_of += tables
    discard(spark, shared)
    return reduce(DataFrame.unionByName, infos), reduce(DataFrame.unionByName, visited), pages_of


def run_scans(data: Collected, options: ScanOptions = ScanOptions()) -> ScanReport:
    """All checks on all scans of ``data``.

    The frontier decides which responses belong to a scan.  Only the tables that the report reads are left on disk.
    """
    spark = data.targets.sparkSession
    responses = _rows(data)
    with scratch(spark), shuffles(spark, tasks_for(spark, responses)):
        info, visited, used = _crawl_groups(data, options, responses)
        findings = [scan_visited(gated_responses(data, options), visited)]
        domains = target_domains(data.targets)
        if data.dns_records is not None:
            findings.append(dns.dns_posture(domains, data.dns_records))
        if data.tls_observations is not None:
            findings.append(tls.tls_posture(data.tls_observations.join(domains, "domain")))
        if data.ct_entries is not None:
            # Written first, so that the join with the scans can split a domain with very many scans.
            with scratch(spark) as names:
                found = materialize(ct.ct_subdomains(data.ct_entries, options.max_subdomains))
            used += names
            findings.append(report.for_scans(found, domains))
        # Written once: the summary and every writer read this narrow table, not the bodies.
        table = materialize(report.all_findings(*findings))
        discard(spark, used)
    return ScanReport(info, report.summary(table, data.targets), table)


def scan_visited(responses: DataFrame, visited: DataFrame) -> DataFrame:
    """Page findings of the visited responses; what repeated responses of a page have in common counts once.

    Findings are made first and joined afterwards, without the texts of their rules: they are few and narrow, so no body is ever
    shuffled.  An inner join, since a semi join may be moved below the checks; visited pages are few enough to come once.
    """
    hits, texts = pages.page_hits(responses.filter(F.col("error").isNull()))
    return pages.described(hits.join(visited, ["scan_id", "url"]), texts).distinct()
