"""The registered queries: every operator on tables derived from the driver's."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webposture import rules, schemas
from webposture.functions import urls as U
from webposture.operators import ct, dns, frontier, links, pacing, pages, report, robots, tls
from webposture.operators.findings import finding_type_label, severity_label
from webposture.plans import fixtures as X
from webposture.plans.scan import Collected, crawl, run_scans
from webposture.session import materialize, shared_dir
from webposture.sources import sinks
from webposture.sources import tables as readers
from webposture.streaming.frontier import dedupe_urls
from webposture.streaming.pacing import start_pacing_sink
from webposture.streaming.pages import running_summary, start_findings_sink, start_scan_sink, stream_findings
from webposture.streaming.upserts import read_upserts, start_upsert_sink

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Pacing of the event log: two requests per day and domain.
PACE, PERIOD = 2.0, 86_400.0


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# Pages

@query
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pages.page_lines(X.responses(spark, sf))


@query
def scan_content(spark: SparkSession, sf: str) -> DataFrame:
    return pages.scan_content(X.responses(spark, sf))


@query
def sensitive_files(spark: SparkSession, sf: str) -> DataFrame:
    return pages.sensitive_files(X.responses(spark, sf))


@query
def missing_headers(spark: SparkSession, sf: str) -> DataFrame:
    return pages.missing_headers(X.responses(spark, sf))


@query
def server_disclosure(spark: SparkSession, sf: str) -> DataFrame:
    return pages.server_disclosure(X.responses(spark, sf))


@query
def scan_page(spark: SparkSession, sf: str) -> DataFrame:
    return pages.scan_page(X.responses(spark, sf))


@query
def size_gate(spark: SparkSession, sf: str) -> DataFrame:
    return pages.size_gate(X.responses(spark, sf), rules.MAX_RESPONSE_BYTES).select("scan_id", "url", "error", "bytes")


# URLs

@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    parsed = U.with_url_parts(X.table(spark, sf, "raw_urls"), "raw_url")
    return parsed.select("url_id", "parts.*")


@query
def normalize_target(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.normalize_targets(X.table(spark, sf, "typed_targets"))


@query
def url_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Frontier key and robots origin of every fetched URL."""
    url = F.col("url")
    return X.responses(spark, sf).select(
        "resp_id", U.strip_fragment(url).alias("frontier_key"), U.origin_of(url).alias("origin"), U.path_of(url).alias("path")
    )


# Links and frontier

@query
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.extract_links(X.page_responses(spark, sf))


@query
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.page_links(X.page_responses(spark, sf))


@query
def same_host_links(spark: SparkSession, sf: str) -> DataFrame:
    return links.same_host_links(links.page_links(X.site_responses(spark, sf)))


@query
def idn_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links to the same host in other spellings of its name."""
    return links.same_host_links(links.page_links(X.idn_responses(spark, sf)))


@query
def seed_probes(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.seed_probes(X.table(spark, sf, "typed_targets"))


def _frontier(spark: SparkSession, sf: str, ordered: bool = False) -> DataFrame:
    start = frontier.seeds(X.table(spark, sf, "crawl_seeds"))
    return frontier.crawl_frontier(start, X.table(spark, sf, "crawl_edges"), ordered=ordered)


@query
def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return _frontier(spark, sf)


@query
def frontier_levels(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.frontier_levels(_frontier(spark, sf))


@query
def visit_order(spark: SparkSession, sf: str) -> DataFrame:
    return frontier.visit_order(_frontier(spark, sf, ordered=True))


def _sites(spark: SparkSession, sf: str) -> Collected:
    return Collected(
        targets=X.table(spark, sf, "site_targets"),
        responses=X.site_responses(spark, sf),
        robots_files=X.table(spark, sf, "site_robots"),
    )


@query
def crawl_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Frontier of every site with the robots decision, from page bodies on."""
    plan, _ = crawl(_sites(spark, sf))
    return plan.select("scan_id", "url", "depth", "allowed")


# robots.txt

@query
def robots_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules_table = robots.robots_rules(X.table(spark, sf, "robots_files"))
    return rules_table.select("origin", F.posexplode("rules").alias("pos", "r")).select(
        "origin", "pos", "r.kind", "r.prefix", "r.len"
    )


def _robots(spark: SparkSession, sf: str) -> DataFrame:
    return robots.robots_rules(X.table(spark, sf, "robots_files"))


@query
def robots_decision(spark: SparkSession, sf: str) -> DataFrame:
    urls = X.responses(spark, sf).select("resp_id", "url")
    return robots.robots_decision(urls, _robots(spark, sf))


@query
def robots_filter(spark: SparkSession, sf: str) -> DataFrame:
    urls = X.responses(spark, sf).select("resp_id", "url")
    return robots.robots_filter(urls, _robots(spark, sf))


# Pacing

@query
def token_bucket_wait(spark: SparkSession, sf: str) -> DataFrame:
    waits = pacing.token_bucket_wait(X.table(spark, sf, "request_log"), PACE, PERIOD)
    return waits.select("domain", "seq", F.round(F.col("wait") * 1e6).cast("bigint").alias("wait_us"))


# Domain posture

def _dns(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.table(spark, sf, "dns_targets"), X.table(spark, sf, "dns_records")


@query
def dns_txt(spark: SparkSession, sf: str) -> DataFrame:
    return dns.txt_records(X.table(spark, sf, "dns_records"))


@query
def dns_spf(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_spf(*_dns(spark, sf))


@query
def dns_dmarc(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_dmarc(*_dns(spark, sf))


@query
def dns_caa(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_caa(*_dns(spark, sf))


@query
def dns_dnssec(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_dnssec(*_dns(spark, sf))


@query
def dns_posture(spark: SparkSession, sf: str) -> DataFrame:
    return dns.dns_posture(*_dns(spark, sf))


@query
def tls_connection(spark: SparkSession, sf: str) -> DataFrame:
    return tls.tls_connection(X.table(spark, sf, "tls_observations"))


@query
def tls_version(spark: SparkSession, sf: str) -> DataFrame:
    return tls.tls_version(X.table(spark, sf, "tls_observations"))


@query
def tls_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return tls.tls_expiry(X.table(spark, sf, "tls_observations"))


@query
def tls_hsts(spark: SparkSession, sf: str) -> DataFrame:
    return tls.tls_hsts(X.table(spark, sf, "tls_observations"))


@query
def tls_posture(spark: SparkSession, sf: str) -> DataFrame:
    return tls.tls_posture(X.table(spark, sf, "tls_observations"))


@query
def ct_subdomains(spark: SparkSession, sf: str) -> DataFrame:
    return ct.ct_subdomains(X.table(spark, sf, "ct_entries"), rules.MAX_SUBDOMAINS)


@query
def ct_subdomain_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every name, without a limit."""
    return ct.ct_subdomains(X.table(spark, sf, "ct_entries")).select("domain", "evidence")


@query
def ct_match_targets(spark: SparkSession, sf: str) -> DataFrame:
    return ct.ct_match_targets(X.table(spark, sf, "ct_entries").select("name_value"), X.table(spark, sf, "dns_targets"))


# Reports

def _findings(spark: SparkSession, sf: str) -> DataFrame:
    targets = X.table(spark, sf, "dns_targets")
    return report.all_findings(
        pages.scan_page(X.responses(spark, sf)),
        dns.dns_posture(targets, X.table(spark, sf, "dns_records")),
        tls.tls_posture(X.table(spark, sf, "tls_observations").join(targets, "domain")),
        report.for_scans(ct.ct_subdomains(X.table(spark, sf, "ct_entries")), targets),
    )


@query
def all_findings(spark: SparkSession, sf: str) -> DataFrame:
    return _findings(spark, sf)


@query
def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    ranked = report.ranked_findings(_findings(spark, sf))
    return ranked.select(
        "scan_id", "url", "title", "evidence", "line_number", "severity_rank", "tag",
        severity_label(F.col("severity")).alias("severity_label"),
        finding_type_label(F.col("finding_type")).alias("type_label"),
    )


@query
def summary(spark: SparkSession, sf: str) -> DataFrame:
    """Severity counts per scan of the page findings; clean scans count 0."""
    scans = X.responses(spark, sf).select("scan_id").unionByName(X.table(spark, sf, "dns_targets").select("scan_id"))
    return report.summary(pages.scan_page(X.responses(spark, sf)), scans)


@query
def scan_info(spark: SparkSession, sf: str) -> DataFrame:
    return run_scans(_sites(spark, sf)).scan_info


@query
def site_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the pages each site's crawl reaches."""
    return run_scans(_sites(spark, sf)).findings


@query
def finding_rows(spark: SparkSession, sf: str) -> DataFrame:
    return report.finding_rows(_findings(spark, sf))


@query
def scan_status(spark: SparkSession, sf: str) -> DataFrame:
    return report.scan_status(X.table(spark, sf, "scan_events"))


@query
def scan_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The nested report of every site as JSON, 3 findings per part."""
    done = run_scans(_sites(spark, sf))
    return report.report_parts(done.scan_info, done.summary, done.findings, part_rows=3)


# Report files: written, and read back.

@query
def scan_report_files(spark: SparkSession, sf: str) -> DataFrame:
    """The findings of one JSON report per site."""
    done, path = run_scans(_sites(spark, sf)), _run_dir(spark, "reports")
    sinks.write_scan_reports(done.scan_info, done.summary, done.findings, path)
    return sinks.read_scan_reports(spark, path)


@query
def csv_report(spark: SparkSession, sf: str) -> DataFrame:
    """The page findings of one CSV report per scan."""
    found, path = materialize(pages.scan_page(X.responses(spark, sf))), _run_dir(spark, "reports")
    counts = report.summary(found)
    sinks.write_scan_reports(counts.select("scan_id"), counts, found, path, "csv")
    return sinks.read_scan_reports(spark, path, "csv")


# Readers: a table is written as Parquet and as lines of JSON, some of them cut off and some rows without a key, and read again.

def _read_back(table: DataFrame, kind: readers.Kind, cut: str, no_key: str, *columns: str) -> DataFrame:
    """Rows of both forms with a ``reason`` of NULL, and the numbers of the others by reason.

    ``cut`` and ``no_key`` say which rows lose their second half as lines, and which lose the last column that they must have.
    """
    spark, path = table.sparkSession, _run_dir(table.sparkSession, "files")
    key = kind.required[-1]
    table = materialize(table.select(*kind.schema.names, F.expr(cut).alias("__cut"), F.expr(no_key).alias("__no_key")))
    table = table.withColumn(key, F.when(~F.coalesce("__no_key", F.lit(False)), F.col(key)))
    line = F.to_json(F.struct(*kind.schema.names))
    lines = F.when(F.coalesce("__cut", F.lit(False)), F.left(line, F.length(line).bitwiseOR(F.lit(1)) - 5)).otherwise(line)
    table.select(*kind.schema.names).write.parquet(f"{path}/parquet")
    table.select(lines.alias("line")).write.text(f"{path}/json")
    found = []
    for fmt in ("parquet", "json"):
        read = readers.read_checked(spark, f"{path}/{fmt}", kind, fmt)
        rows = read.rows.selectExpr(*columns)
        nothing = [F.lit(None).cast(t).alias(n) for n, t in rows.dtypes]
        found.append(rows.withColumns({"reason": F.lit(None).cast("string"), "n": F.lit(1).cast("long")}))
        found.append(read.counts().select(*nothing, "reason", F.col("n")))
        found[-2:] = [f.withColumn("fmt", F.lit(fmt)) for f in found[-2:]]
    return reduce(DataFrame.unionByName, found)


@query
def read_responses(spark: SparkSession, sf: str) -> DataFrame:
    pages_of = X.responses(spark, sf).withColumn("fetched_at", F.lit(None).cast("timestamp"))
    return _read_back(
        pages_of, readers.RESPONSES, "status = 404", "url like '%/.npmrc'",
        "scan_id", "url", "status", "size(headers) as headers", "octet_length(body) as bytes", "content_length", "fetch_error",
    )


@query
def read_robots(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(X.table(spark, sf, "robots_files"), readers.ROBOTS, "status is null", "status = 404", "origin", "status", "content")


@query
def read_dns(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(X.table(spark, sf, "dns_records"), readers.DNS, "rrtype = 'CAA'", "rrtype = 'DNSKEY'", *schemas.DNS_RECORDS.names)


@query
def read_tls(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(X.table(spark, sf, "tls_observations"), readers.TLS, "not http_ok", "protocol = 'TLSv1.0'", *schemas.TLS_OBSERVATIONS.names)


@query
def read_ct(spark: SparkSession, sf: str) -> DataFrame:
    return _read_back(
        X.table(spark, sf, "ct_entries"), readers.CT, "name_value like ' %'", "name_value = 'www.unrelated.example.org'", "domain", "name_value"
    )


# Streams: every query runs until the source is drained and returns what the sink holds.

def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as a stream, be it a file or a folder of files; the path is a pattern, since a stream reads no single file by its name."""
    batch = spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(batch.schema).parquet(f"{sf}/{name}.parque[t]")


def _response_stream(spark: SparkSession, sf: str) -> DataFrame:
    flat = X.bind(spark, "responses_flat", documents=_stream(spark, sf, "documents"))
    return X.with_headers(flat).withColumnRenamed("target", "scan_id")


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid4().hex}"


def _drain(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    run = _run_dir(spark, name)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{run}/checkpoint").format(
        "parquet").start(f"{run}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


@query
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _drain(stream_findings(_response_stream(spark, sf)), "scan")


@query
def stream_scan_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the pages that robots rules allow, the rules read anew for every batch."""
    run = _run_dir(spark, "allowed")
    start_scan_sink(
        _response_stream(spark, sf), f"{run}/out", f"{run}/checkpoint", lambda s: X.table(s, sf, "robots_files"), available_now=True
    ).awaitTermination()
    return _rows_in(spark, f"{run}/out")


def _rows_in(spark: SparkSession, path: str) -> DataFrame:
    rows = report.finding_rows(spark.createDataFrame([], schemas.FINDINGS)).schema
    return spark.read.schema(rows).parquet(path).select(rows.names)


@query
def stream_append_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings-table rows in a store that only appends, every batch delivered twice as after a failure."""
    run = _run_dir(spark, "append")
    columns = report.finding_rows(spark.createDataFrame([], schemas.FINDINGS)).columns
    stored = ", ".join(f"{c} string" for c in [*columns, "query_id", "row_key"]) + ", batch_id long"
    store = lambda s: s.read.schema(stored).parquet(f"{run}/out")
    once = sinks.append_sink(lambda rows: rows.write.mode("append").parquet(f"{run}/out"), store, f"{run}/log", "scan")

    def twice(batch: DataFrame, batch_id: int) -> None:
        once(batch, batch_id)
        once(batch, batch_id)

    stream_findings(_response_stream(spark, sf)).writeStream.foreachBatch(twice).trigger(availableNow=True).option(
        "checkpointLocation", f"{run}/checkpoint").start().awaitTermination()
    return store(spark).select(columns)


@query
def stream_finding_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Findings-table rows as the idempotent sink leaves them."""
    run = _run_dir(spark, "rows")
    start_findings_sink(
        stream_findings(_response_stream(spark, sf)), f"{run}/out", f"{run}/checkpoint", available_now=True
    ).awaitTermination()
    return _rows_in(spark, f"{run}/out")


@query
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    edges = X.bind(spark, "crawl_edges", orders=_stream(spark, sf, "orders"))
    found = edges.select(F.lit("all").alias("scan_id"), F.col("dst_url").alias("url"))
    return _drain(dedupe_urls(found), "dedupe")


@query
def stream_dedupe_within(spark: SparkSession, sf: str) -> DataFrame:
    """First sightings of pages, remembered for a day of event time beyond the latest one."""
    seen = X.bind(spark, "url_sightings", events=_stream(spark, sf, "events"))
    return _drain(dedupe_urls(seen, "seen_at"), "within").select("scan_id", "url")


@query
def stream_pacing_wait(spark: SparkSession, sf: str) -> DataFrame:
    log = X.bind(spark, "request_log", events=_stream(spark, sf, "events"))
    run = _run_dir(spark, "pacing")
    start_pacing_sink(log, run, f"{run}/checkpoint", PACE, PERIOD, available_now=True).awaitTermination()
    waits = spark.read.schema("domain string, ts timestamp, seq bigint, wait double").parquet(f"{run}/waits")
    return waits.select("domain", "seq", F.round(F.col("wait") * 1e6).cast("bigint").alias("wait_us"))


@query
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Running severity counts once the source is drained; a batch writes the scans that it changed."""
    counts = running_summary(stream_findings(_response_stream(spark, sf)))
    run = _run_dir(spark, "summary")
    start_upsert_sink(counts, f"{run}/out", f"{run}/checkpoint", ["scan_id"], available_now=True).awaitTermination()
    return read_upserts(spark, f"{run}/out", counts.schema, ["scan_id"])
