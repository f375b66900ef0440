"""What the collected tables may hold: URLs in any spelling, repeated pages and origins, null keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from webposture import Collected, run_scans, schemas
from webposture.functions import urls as U
from webposture.operators import robots
from webposture.operators.ordering import with_rank
from webposture.plans.scan import unreadable_responses

NOON = datetime(2024, 5, 1, 12)


def page(url, body="<a href='next'>n</a>", at=NOON):
    return ("s", url, 200, [("Content-Type", "text/html")], body, None, None, at)


def scan(spark, pages, target="https://Shop.example"):
    return run_scans(Collected(
        targets=spark.createDataFrame([("s", target)], schemas.TARGETS),
        responses=spark.createDataFrame(pages, schemas.RESPONSES),
    ))


def rows(df):
    return sorted(tuple(r) for r in df.select("url", "severity", "title", "evidence").collect())


def test_relative_link_of_a_page_without_path(spark):
    frame = spark.createDataFrame([("https://shop.example", h) for h in ("cart", "?a=1", "/x", "#top")], "base string, href string")
    got = [r[0] for r in frame.select(U.join_url(F.col("base"), F.col("href"))).collect()]
    assert got == ["https://shop.example/cart", "https://shop.example?a=1", "https://shop.example/x", "https://shop.example#top"]


def test_responses_in_another_spelling(spark):
    want = scan(spark, [page("https://shop.example/"), page("https://shop.example/next", "")])
    got = scan(spark, [page("https://Shop.example"), page("HTTPS://shop.example:443/./next#part", "")])
    assert rows(got.findings) == rows(want.findings) != []
    assert {r[0] for r in rows(got.findings)} == {"https://shop.example/", "https://shop.example/next"}


def test_repeated_responses_count_once(spark):
    once, twice = [page("https://shop.example/")], [page("https://shop.example/")] * 2
    assert rows(scan(spark, once).findings) == rows(scan(spark, twice).findings) != []
    assert scan(spark, once).scan_info.drop("started_at", "completed_at").collect() == scan(spark, twice).scan_info.drop("started_at", "completed_at").collect()


def test_unreadable_urls_are_counted(spark):
    frame = spark.createDataFrame([page("ftp://shop.example/"), page("no url"), page("no url"), page("https://shop.example/")], schemas.RESPONSES)
    assert sorted(tuple(r) for r in unreadable_responses(frame).collect()) == [("s", "ftp://shop.example/", 1), ("s", "no url", 2)]


def test_one_rule_set_per_origin(spark):
    files = [("https://a.example", 404, None), ("https://a.example", 200, "User-agent: *\nDisallow: /own\n"), ("https://b.example", None, None)]
    got = robots.robots_rules(spark.createDataFrame(files, schemas.ROBOTS_FILES))
    assert sorted((r.origin, len(r.rules)) for r in got.collect()) == [("https://a.example", 1), ("https://b.example", 0)]


def test_ranks_of_null_keys(spark):
    frame = spark.createDataFrame([(None, 2), (None, 1), ("k", 5)], "key string, at long")
    assert sorted((r["key"] or "", r["at"], r["rank"], r["first"]) for r in with_rank(frame, ["key"], ["at"]).collect()) == [
        ("", 1, 0, 1), ("", 2, 1, 1), ("k", 5, 0, 5),
    ]
