"""Links of HTML pages: extraction, resolution, host filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture import rules
from webposture.functions import headers as H
from webposture.functions import html
from webposture.functions import urls as U
from webposture.functions.text import any_of, keep_where, trim_space


def page_hrefs(responses: DataFrame) -> DataFrame:
    """Replace ``body`` and ``headers`` by ``hrefs``: the raw links of HTML responses, NULL for others."""
    found = F.when(H.is_html(F.col("headers")), html.raw_hrefs(F.col("body")))
    return responses.withColumn("hrefs", found).drop("body", "headers")


def links_of(pages: DataFrame) -> DataFrame:
    """One row per link of ``page_hrefs``: not empty, not on the skip list, in document order."""
    href = F.col("href")
    skipped = any_of([href.startswith(prefix) for prefix in rules.SKIPPED_HREF_PREFIXES])
    # Outer: otherwise a filter on the list is added below, which reads every body a second time.
    raw = pages.select("scan_id", F.col("url").alias("src_url"), F.posexplode_outer("hrefs").alias("pos", "raw"))
    # One step at a time: each uses its input more than once.
    found = raw.withColumn("raw", html.unquoted(F.col("raw"))).withColumn("raw", html.decode_references(F.col("raw")))
    raw = F.col("raw")
    found = found.select("scan_id", "src_url", "pos", F.when(raw.rlike(r"[^\x21-\x7e]"), trim_space(raw)).otherwise(raw).alias("href"))
    return keep_where(found, (href != "") & ~skipped, "href")


def extract_links(responses: DataFrame) -> DataFrame:
    """The links of HTML responses: (scan_id, src_url, pos, href)."""
    return links_of(page_hrefs(responses))


def resolve_links(links: DataFrame) -> DataFrame:
    """Absolute http(s) target of every link: (scan_id, src_url, pos, dst_url).

    Links that lead to other schemes or to no valid URL are dropped.
    """
    cleaned = links.withColumn("href", U.clean(F.col("href")))
    joined = cleaned.withColumn("__target", U.join_url(F.col("src_url"), F.col("href"), cleaned=True))
    return U.normalized(joined, "__target", "dst_url").select("scan_id", "src_url", "pos", "dst_url")


def same_host_links(links: DataFrame) -> DataFrame:
    """Links that stay on exactly the host of their page; subdomains are other hosts.

    Pages of a crawl that never leaves its host are on that host, so no target list is needed.
    """
    return links.filter(U.same_host(F.col("dst_url"), F.col("src_url")))


def page_links(responses: DataFrame) -> DataFrame:
    """Extraction and resolution in one go."""
    return resolve_links(extract_links(responses))
