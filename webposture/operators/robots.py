"""robots.txt rules and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.functions import urls as U
from webposture.functions.text import trim_space


def _rule_lines(content: Column) -> Column:
    """Trimmed lines of all sections whose agent is exactly ``*``; the latest agent line counts."""
    sections = F.split(content, r"(?imd)^(?U:[^\S\n]*)user-agent:", -1)
    bodies = F.transform(F.slice(sections, F.lit(2), F.size(sections)), lambda s: F.split(s, "\n", -1))
    general = F.filter(bodies, lambda lines: trim_space(F.get(lines, F.lit(0))) == "*")
    return F.transform(F.flatten(general), trim_space)


def parse_rules(content: Column) -> Column:
    """Allow and disallow prefixes as ``array<struct<kind,prefix,len>>``, len in bytes.

    One expression per file, no shuffle.  Comments and blank lines match neither keyword, and an
    empty path is no rule.
    """

    def rule(line: Column) -> Column:
        prefix = trim_space(F.regexp_extract(line, r"(?s)^[^:]*:(.*)\z", 1))
        kind = F.lower(F.regexp_extract(line, r"(?i)^(allow|disallow):", 1))
        return F.struct(kind.alias("kind"), prefix.alias("prefix"), F.octet_length(prefix).alias("len"))

    rules = F.transform(_rule_lines(content), rule)
    return F.filter(rules, lambda r: (r["kind"] != "") & (r["prefix"] != ""))


def robots_rules(files: DataFrame) -> DataFrame:
    """One row per origin of ``robots_files``, its rules as one array; only 2xx content has rules.

    The first fetch of an origin counts, by ``fetched_at`` where there is such a column; of several at
    that time, and without the column, the one with the least status and then content.
    """
    order = [F.col("fetched_at").isNull(), F.col("fetched_at")] if "fetched_at" in files.columns else []
    order = F.struct(*order, F.col("status").isNull(), "status", "content")
    # Hashed too, so that a later join on the origin shuffles anew and can split hot origins.
    first = files.groupBy("origin", F.xxhash64("origin")).agg(F.min_by(F.struct("status", "content"), order).alias("f"))
    files = first.select("origin", "f.status", "f.content")
    served = F.when(F.col("status").between(200, 299), F.col("content"))
    return files.select("origin", F.coalesce(parse_rules(served), F.array()).alias("rules"))


def is_allowed(path: Column, rules: Column) -> Column:
    """The longest matching prefix decides, allow on a tie; no wildcards, and no rules allow all."""
    matching = F.filter(rules, lambda r: F.startswith(path, r["prefix"]))

    def longest(kind: str) -> Column:
        lengths = F.transform(F.filter(matching, lambda r: r["kind"] == kind), lambda r: r["len"])
        return F.coalesce(F.array_max(lengths), F.lit(-1))

    allow, disallow = longest("allow"), longest("disallow")
    return F.coalesce((disallow == -1) | (allow >= disallow), F.lit(True))


def robots_decision(urls: DataFrame, rules: DataFrame, ignore: bool = False) -> DataFrame:
    """Add ``allowed`` to ``urls`` (normalised URLs).  Unknown origins are allowed.

    The rules stay one array per origin, so no URL row is multiplied.  The join is left to the
    planner: it broadcasts the rules if their size allows and splits skewed origins otherwise.
    """
    if ignore:
        return urls.withColumn("allowed", F.lit(True))
    url = F.col("url")
    # The path is made before the join: within the rule filters it would be made for every rule.
    keyed = urls.withColumns({"__origin": U.origin_of(url), "__path": U.path_of(url)})
    joined = keyed.join(rules.select(F.col("origin").alias("__origin"), F.col("rules").alias("__rules")), "__origin", "left")
    return joined.withColumn("allowed", is_allowed(F.col("__path"), F.col("__rules"))).drop(
        "__origin", "__path", "__rules"
    )


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The URLs that may be fetched."""
    return robots_decision(urls, rules).filter("allowed").drop("allowed")
