"""A hot key must be split at run time, not end up in one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from webposture import schemas
from webposture.operators import ct, dns, frontier, report, robots
from webposture.session import bucketed, materialize

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.files.maxPartitionBytes": "64KB",
}


@pytest.fixture
def skewed(spark):
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key in SETTINGS:
        spark.conf.unset(key)


def splits(df) -> bool:
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot_domains(spark):
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    return materialize(spark.range(0, 12_000, 1, 4).select(
        F.sha2(F.col("id").cast("string"), 256).alias("scan_id"), F.concat(F.lit("d"), hot.cast("string"), F.lit(".com")).alias("domain")))


def test_domain_of_very_many_scans(skewed):
    records = skewed.createDataFrame([("d0.com", "d0.com", "TXT", 0, 0, "v=spf1 -all")], schemas.DNS_RECORDS)
    assert splits(dns.dns_caa(hot_domains(skewed), records))


def test_origin_of_very_many_urls(skewed):
    urls = hot_domains(skewed).select(F.concat(F.lit("https://"), "domain", F.lit("/"), "scan_id").alias("url"))
    files = skewed.createDataFrame([("https://d0.com", 200, "User-agent: *\nDisallow: /a")], schemas.ROBOTS_FILES)
    assert splits(robots.robots_decision(urls, robots.robots_rules(files)))


def test_findings_for_very_many_scans(skewed):
    domains = hot_domains(skewed)
    found = materialize(skewed.createDataFrame([("u", "info", "tls_issue", "t", "d", "e", 1, "d0.com")], "url string, severity string, finding_type string, title string, description string, evidence string, line_number int, domain string"))
    assert splits(report.for_scans(found, domains))


def test_page_in_very_many_frontiers(skewed):
    scans = hot_domains(skewed).select("scan_id", F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"))
    links = materialize(frontier.link_keys(skewed.createDataFrame([("https://d0.com/", "https://d0.com/a")], "src_url string, dst_url string")))
    assert splits(scans.withColumnRenamed("url", "src_url").join(links, "src_url"))


def test_names_of_a_hot_target(skewed):
    feed = materialize(skewed.range(0, 12_000, 1, 4).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".hot.com")).alias("name_value")))
    targets = materialize(skewed.createDataFrame([("hot.com",), ("cold.com",)], "domain string"))
    assert splits(ct.ct_match_targets(feed, targets))


def test_one_exchange_per_level(skewed):
    """Links of one scan each: neither the join with the links nor those with earlier levels shuffle."""
    level = skewed.createDataFrame([("s", f"https://e.com/{k}") for k in range(9)], "scan_id string, url string")
    levels = [bucketed(level.withColumn("depth", F.lit(d)), ["scan_id", "url"], 4) for d in range(2)]
    links = skewed.createDataFrame([("s", f"https://e.com/{k}", f"https://e.com/{k + 1}", 0) for k in range(9)], "scan_id string, src_url string, dst_url string, pos int")
    edges = bucketed(frontier.link_keys(links), ["scan_id", "src_url"], 4)
    fresh = frontier.unseen(frontier.next_level(levels[-1], edges, ["scan_id"], False).distinct(), levels, True)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("LeftAnti") == 2
    assert [tuple(r) for r in fresh.collect()] == [("s", "https://e.com/9")]
    assert not [t.name for t in skewed.catalog.listTables() if t.name.startswith("webposture_")]
