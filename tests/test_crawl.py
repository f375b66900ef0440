from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webposture import rules, schemas, session
from webposture.operators import frontier, pacing, robots
from webposture.operators.ordering import with_rank
from webposture.plans import fixtures
from webposture.plans.scan import Collected, crawl

HOST = "https://example.com"


def decide(spark, content, paths, status=200, **options):
    files = spark.createDataFrame([(HOST, status, content)], schemas.ROBOTS_FILES)
    urls = spark.createDataFrame([(i, HOST + p) for i, p in enumerate(paths)], "n int, url string")
    rows = robots.robots_decision(urls, robots.robots_rules(files), **options).collect()
    return [r.allowed for r in sorted(rows, key=lambda r: r.n)]


ROBOTS = [
    ("User-agent: *\nDisallow: /stock\nAllow: /stock/list\nDisallow: /stock/list/old\n",
     {"/": True, "/stoc": True, "/stock": False, "/stocks": False, "/stock/list": True, "/stock/list/7": True, "/stock/list/older": False}),
    ("\n \n", {"/q": True}),
    ("User-agent: *\nDisallow: /\nAllow: /t\n", {"/": False, "/s": False, "/t": True, "": False}),
    ("User-agent: crawler-x\nDisallow: /q\n\nUser-agent: *\nDisallow: /r\n", {"/q": True, "/r/1": False}),
    ("#all\nUser-agent: *\n # \n#Disallow: /u\nDisallow: /v\n", {"/u": True, "/v": False}),
    ("User-agent: *\nUser-agent: other\nDisallow: /x", {"/x": True}),
    ("User-agent: *\r\nDISALLOW: /x  \r\nallow:/x/y\r\nUser-agent: a\nDisallow: /z\nUSER-AGENT:*\nDisallow: /w", {"/x": False, "/x/y": True, "/z": True, "/w": False}),
    ("User-agent: *\nDisallow: /x\nAllow: /x\nDisallow: /y # not here\nDisallow:\nDisallow: /*.pdf", {"/x": True, "/y": True, "/a.pdf": True, "/?q=/x": True}),
    ("User-agent: *\nDisallow: /é\nAllow: /ab", {"/ab": True}),
    ("Disallow: /early\nUser-agent: * \nDisallow : /sp\n#Disallow: /c", {"/early": True, "/sp": True, "/c": True}),
]


@pytest.mark.parametrize("content,want", ROBOTS)
def test_robots(spark, content, want):
    assert decide(spark, content, list(want)) == list(want.values())


def test_robots_need_success(spark):
    block = "User-agent: *\nDisallow: /"
    assert decide(spark, block, ["/x"], 404) == [True]
    assert decide(spark, block, ["/x"], None) == [True]
    assert decide(spark, block, ["/x"], 204) == [False]
    assert decide(spark, block, ["/x"], ignore=True) == [True]


def test_robots_origin_has_no_port(spark):
    files = spark.createDataFrame([(HOST, 200, "User-agent: *\nDisallow: /")], schemas.ROBOTS_FILES)
    urls = spark.createDataFrame([(HOST + ":8443/x",), ("http://example.com/x",), ("https://unknown.com/x",)], "url string")
    assert [r.allowed for r in robots.robots_decision(urls, robots.robots_rules(files)).orderBy("url").collect()] == [True, False, True]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["Allow", "Disallow"]), st.text("ab/", min_size=1, max_size=4)), max_size=8), st.lists(st.text("ab/", max_size=6), min_size=1, max_size=10))
def test_robots_against_prefix_search(spark, lines, tails):
    content = "User-agent: *\n" + "\n".join(f"{k}: /{p}" for k, p in lines)
    paths = ["/" + t for t in tails]

    def naive(path):
        longest = {k: max([len(p) for kk, p in lines if kk == k and path.startswith("/" + p)], default=-1) for k in ("Allow", "Disallow")}
        return longest["Disallow"] < 0 or longest["Allow"] >= longest["Disallow"]

    assert decide(spark, content, paths) == [naive(p) for p in paths]


def walk(spark, edges, seeds=("https://e.com/0",), depth=3, **options):
    start = spark.createDataFrame([("s", s, i) for i, s in enumerate(seeds)], "scan_id string, url string, pos int")
    links = spark.createDataFrame([(f"https://e.com/{a}", b if b.startswith("http") else f"https://e.com/{b}", i) for i, (a, b) in enumerate(edges)], "src_url string, dst_url string, pos int")
    return frontier.crawl_frontier(start, links, depth, **options)


def depths(df):
    return {r.url.removeprefix("https://e.com/"): r.depth for r in df.collect()}


def test_frontier_depth_fragment_and_host(spark):
    edges = [("0", "1"), ("0", "1#x"), ("1", "2"), ("2", "0"), ("2", "3"), ("3", "4"), ("0", "https://o.com/"), ("0", "http://e.com/"), ("1", "?q"), ("1", "1/")]
    want = {"0": 0, "1": 1, "2": 2, "3": 3, "http://e.com/": 1, "?q": 2, "1/": 2}
    assert depths(walk(spark, edges)) == want
    assert depths(walk(spark, edges, depth=0)) == {"0": 0}
    assert depths(walk(spark, edges, depth=1, cross_domain=True)) == {"0": 0, "1": 1, "http://e.com/": 1, "https://o.com/": 1}


def test_links_of_a_scan_stay_in_it(spark):
    start = spark.createDataFrame([("a", "https://e.com/0"), ("b", "https://e.com/0")], "scan_id string, url string")
    links = spark.createDataFrame([("a", "https://e.com/0", "https://e.com/1")], "scan_id string, src_url string, dst_url string")
    found = frontier.crawl_frontier(start, links)
    assert sorted((r.scan_id, r.url[-1], r.depth) for r in found.collect()) == [("a", "0", 0), ("a", "1", 1), ("b", "0", 0)]
    assert sorted(tuple(r) for r in frontier.frontier_levels(found).collect()) == [("a", 0, 1), ("a", 1, 1), ("b", 0, 1)]


def test_visit_order_is_that_of_a_queue(spark):
    rng = random.Random(7)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(200)]
    queue, seen = [("0", 0)], {"0"}
    for url, depth in queue:
        for a, b in edges:
            if a == url and b not in seen and depth < 3:
                seen.add(b)
                queue.append((b, depth + 1))
    got = frontier.visit_order(walk(spark, edges, ordered=True)).orderBy("visit_no").collect()
    assert [(r.url.removeprefix("https://e.com/"), r.depth) for r in got] == queue
    assert [r.visit_no for r in got] == list(range(1, len(queue) + 1))


def test_probes(spark):
    targets = spark.createDataFrame([("s", "Example.com/deep/page?x#y"), ("t", "https://")], schemas.TARGETS)
    rows = frontier.seed_probes(targets).orderBy("pos").collect()
    assert [r.url for r in rows] == ["https://example.com" + p.path for p in rules.SENSITIVE_PATHS]
    assert [r.url for r in frontier.seeds(targets).collect()] == ["https://example.com/deep/page?x"]


def simulate(times, rate):
    tokens, last, waits = rate, None, []
    for t in times:
        tokens = min(rate, tokens + (0 if last is None else (t - last) * rate))
        last = t
        waits.append(0.0 if tokens >= 1 else (1 - tokens) / rate)
        tokens -= 1
    return waits


def log(spark, rows):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(d, start + timedelta(seconds=t), i) for i, (d, t) in enumerate(rows)], schemas.REQUEST_LOG)


def check_pacing(spark, rows, rate):
    got = {}
    for r in pacing.token_bucket_wait(log(spark, rows), rate).collect():
        got.setdefault(r.domain, {})[r.seq] = r.wait
    for domain in {d for d, _ in rows}:
        own = sorted((t, i) for i, (d, t) in enumerate(rows) if d == domain)
        for (_, i), want in zip(own, simulate([t for t, _ in own], rate)):
            assert abs(got[domain][i] - want) < 1e-6


def test_pacing_basics(spark):
    check_pacing(spark, [("a", 0.0), ("a", 0.0), ("a", 0.0), ("b", 0.0)], 2.0)
    with pytest.raises(ValueError):
        pacing.token_bucket_wait(log(spark, [("a", 0.0)]), 0)


@pytest.fixture
def small_chunks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pacing_of_a_hot_domain_spread_over_chunks(spark, small_chunks):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"d{rng.randrange(5)}", round(rng.random() * 300, 3)) for _ in range(4000)]
    check_pacing(spark, rows, 10.0)
    chunks = with_rank(log(spark, rows), ["domain"], ["ts", "seq"]).filter("domain = 'hot'").select("chunk").distinct().count()
    assert chunks > 1


def test_rank_is_dense_per_key(spark, small_chunks):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.hash("id").alias("v"), "id")
    wrong = with_rank(df, ["k"], ["v", "id"]).selectExpr("*", "row_number() over (partition by k order by v, id) - 1 as want").filter("rank <> want")
    assert wrong.count() == 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    chain = [("s", f"https://e.com/{k}", f"https://e.com/{k + 1}") for k in range(60)]
    start = spark.createDataFrame([("s", "https://e.com/0")], "scan_id string, url string")
    links = spark.createDataFrame(chain, "scan_id string, src_url string, dst_url string")
    want = sorted(tuple(r) for r in frontier.crawl_frontier(start, links).collect())
    monkeypatch.setattr(session, "TASK_ROWS", 5)
    dealt, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    kept = frontier.bucketed
    monkeypatch.setattr(frontier, "bucketed", lambda df, keys, buckets: dealt.append(buckets) or kept(df, keys, buckets))
    assert sorted(tuple(r) for r in frontier.crawl_frontier(start, links).collect()) == want and len(want) == 4
    assert set(dealt) == {12} and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_targets_are_spread_before_they_become_probes(spark, monkeypatch):
    monkeypatch.setattr("webposture.plans.scan.TARGETS_A_TASK", 10)
    seeds = []
    reached = frontier.crawl_frontier
    monkeypatch.setattr(frontier, "crawl_frontier", lambda start, *rest: seeds.append(start) or reached(start, *rest))
    targets = spark.createDataFrame([(f"s{k}", f"https://e{k}.com/") for k in range(40)], schemas.TARGETS).coalesce(1)
    plan, _ = crawl(Collected(targets, spark.createDataFrame([], schemas.RESPONSES)))
    assert plan.count() == 40 * (1 + len(rules.SENSITIVE_PATHS))
    assert seeds[0].rdd.getNumPartitions() == 8


def test_narrow_rows_are_spread_before_they_become_many(spark, tmp_path, monkeypatch):
    orders = spark.range(0, 100, 1, 1).selectExpr("id as o_orderkey", "id % 7 as o_custkey")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    for name, n in (("crawl_edges", 400), ("idn_pages", 100)):
        monkeypatch.setitem(fixtures.SPREAD, name, 10)
        found = fixtures.table(spark, str(tmp_path), name)
        assert found.count() == n and found.rdd.getNumPartitions() == 10
