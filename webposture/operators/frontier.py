"""Crawl frontier: depth-limited, deduplicated breadth-first search over a link table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture import rules
from webposture.functions import urls as U
from webposture.operators.ordering import with_rank
from webposture.operators.robots import robots_decision
from webposture.session import bucketed, discard, materialize, scratch, shuffles, tasks_for


def normalize_targets(targets: DataFrame) -> DataFrame:
    """Add the missing scheme to ``target_url``."""
    return targets.withColumn("target_url", U.with_scheme(F.col("target_url")))


def seeds(targets: DataFrame) -> DataFrame:
    """The targets as frontier rows (scan_id, url, pos 0); invalid target URLs have no scan."""
    valid = U.normalized(normalize_targets(targets), "target_url", "__url")
    return valid.select("scan_id", U.strip_fragment(F.col("__url")).alias("url"), F.lit(0).alias("pos"))


def seed_probes(targets: DataFrame, paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS) -> DataFrame:
    """One row per target and probed path, pos from 1: the paths joined to the target's site."""
    site = F.regexp_extract("url", r"^https?://[^/?#]*", 0)
    probed = seeds(targets).select("scan_id", site.alias("site"),
                                   F.posexplode(F.array(*[F.lit(p.path) for p in paths])).alias("n", "path"))
    return probed.select("scan_id", F.concat("site", "path").alias("url"), (F.col("n") + 1).cast("int").alias("pos"))


def link_keys(links: DataFrame, cross_domain: bool = False, tasks: int | None = None) -> DataFrame:
    """Links as (scan_id if given, src_url, dst_url, pos): fragments off, repeats merged, host checked.

    With ``tasks`` the links of a page are in one of so many tasks.
    """
    src, dst = F.col("src_url"), F.col("dst_url")
    keyed = links.withColumns({"src_url": U.strip_fragment(src), "dst_url": U.strip_fragment(dst)})
    if not cross_domain:
        keyed = keyed.filter(U.same_host(src, dst))
    scope = [c for c in ("scan_id",) if c in links.columns]
    if tasks is not None:
        keyed = keyed.repartition(tasks, *scope, "src_url")
    pos = F.min("pos") if "pos" in links.columns else F.lit(0)
    return keyed.groupBy(*scope, "src_url", "dst_url").agg(pos.cast("int").alias("pos"))


def crawl_frontier(
    start: DataFrame,
    links: DataFrame,
    max_depth: int = rules.DEFAULT_DEPTH,
    cross_domain: bool = False,
    ordered: bool = False,
    most_links: int | None = None,
) -> DataFrame:
    """Every URL a crawl accepts, with its least depth: (scan_id, url, depth[, ord]).

    ``start``: (scan_id, url[, pos]) at depth 0.  ``links``: (src_url, dst_url[, pos]), shared by all
    scans or, with a scan_id, of one scan each.  ``ordered`` adds ``ord``, the positions on the way
    from the seed, which sorts the URLs of a depth in the order a first-in first-out queue would.

    One join per level, and each level is written once.  Links of one scan each are written in buckets of (scan_id, src_url), and levels in buckets of (scan_id, url): then
    merging repeats is a level's only exchange.  There are as many buckets as the links and seeds take, so that a task's share stays the
    same; ``most_links``, a number that the links surely don't exceed, spares writing them to be counted.  Links that all scans share keep plain shuffles, since there a page that very many
    scans reach at once is a hot key, which run-time splitting needs a shuffle for.
    """
    scope = [c for c in ("scan_id",) if c in links.columns]
    spark = start.sparkSession
    with scratch(spark) as made:
        if scope and most_links is not None:
            buckets = tasks_for(spark, max(most_links, start.count()))
            edges = bucketed(link_keys(links, cross_domain, buckets), [*scope, "src_url"], buckets)
        else:
            edges = materialize(link_keys(links, cross_domain))
            buckets = tasks_for(spark, max(edges.count(), start.count()) if scope else 0)
            if scope:
                edges = bucketed(edges, [*scope, "src_url"], buckets)
                discard(spark, made[:1])
    position = F.col("pos") if "pos" in start.columns else F.lit(0)
    start = start.select("scan_id", U.strip_fragment(F.col("url")).alias("url"), F.array(position.cast("int")).alias("ord"))
    # min of an array compares position by position
    first = (lambda df: df.groupBy("scan_id", "url").agg(F.min("ord").alias("ord"))) if ordered else (
        lambda df: df.select("scan_id", "url").distinct()
    )
    keep = (lambda level: bucketed(level, ["scan_id", "url"], buckets)) if scope else materialize
    with shuffles(spark, buckets):
        levels = [keep(first(start).withColumn("depth", F.lit(0)))]
        for depth in range(1, max_depth + 1):
            fresh = unseen(first(next_level(levels[-1], edges, scope, ordered)), levels, bool(scope))
            level = keep(fresh.withColumn("depth", F.lit(depth)))
            if level.isEmpty():
                break
            levels.append(level)
    discard(spark, made)
    return reduce(DataFrame.unionByName, levels)


def next_level(level: DataFrame, edges: DataFrame, scope: Sequence[str], ordered: bool) -> DataFrame:
    """Where the links of a level lead, repeats included."""
    found = level.withColumnRenamed("url", "src_url").join(edges, [*scope, "src_url"])
    columns = ["scan_id", F.col("dst_url").alias("url")]
    if ordered:
        columns.append(F.concat("ord", F.array("pos")).alias("ord"))
    return found.select(*columns)


def unseen(found: DataFrame, levels: Sequence[DataFrame], in_buckets: bool) -> DataFrame:
    """What no earlier level has.

    Levels in buckets are joined where they lie, one after the other.  A union of them would lose the buckets, but is shuffled
    only once where there are none.
    """
    seen = [level.select("scan_id", "url") for level in levels]
    if not in_buckets:
        seen = [reduce(DataFrame.unionByName, seen)]
    return reduce(lambda left, right: left.join(right, ["scan_id", "url"], "left_anti"), seen, found)


def frontier_levels(frontier: DataFrame) -> DataFrame:
    """Queue length per scan and depth."""
    return frontier.groupBy("scan_id", "depth").agg(F.count("*").alias("urls"))


def visit_order(frontier: DataFrame) -> DataFrame:
    """Number the URLs of an ordered frontier per scan, from 1, in queue order."""
    return with_rank(frontier, ["scan_id"], ["depth", "ord", "url"]).select(
        "scan_id", "url", "depth", (F.col("rank") + 1).alias("visit_no")
    )


def crawl_plan(frontier: DataFrame, robots: DataFrame, ignore_robots: bool = False) -> DataFrame:
    """The frontier with ``allowed``: which URLs robots rules let a crawler fetch."""
    return robots_decision(frontier, robots, ignore_robots)
