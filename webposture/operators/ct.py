"""Subdomains from certificate-transparency names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webposture.functions.text import trim_space
from webposture.session import materialize

#: Bits for each target and bits of a domain; 3 in 1000 others pass.
BLOOM_BITS, BLOOM_HASHES = 12, 4
#: The largest filter: a million words of 64 bits, 16 MB.
BLOOM_MOST_BITS = 1 << 26


def _names(name_value: Column) -> Column:
    """The names of an entry: one per line, without leading ``*.``, lower-cased."""
    return F.transform(
        F.split(name_value, "\n", -1), lambda n: F.lower(F.regexp_replace(trim_space(n), r"^(\*\.)++", ""))
    )


def subdomain_names(entries: DataFrame) -> DataFrame:
    """Distinct (domain, subdomain); a name counts if it ends with the domain, even mid-label."""
    sub, domain = F.col("subdomain"), F.col("domain")
    return (
        entries.select("domain", F.explode(_names(F.col("name_value"))).alias("subdomain"))
        .filter((sub != "") & F.endswith(sub, domain) & (sub != domain))
        .distinct()
    )


def subdomain_findings(names: DataFrame, limit: int | None = None) -> DataFrame:
    """One info finding for each name of a domain; with ``limit``, for its first ones in byte order.

    The rank filter becomes a group limit before the shuffle, so a domain with millions of names
    sends only ``limit`` per task.
    """
    first = names
    if limit is not None:
        order = Window.partitionBy("domain").orderBy("subdomain")
        first = names.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit)
    sub = F.col("subdomain")
    return first.select(
        "domain",
        F.concat(F.lit("https://"), sub).alias("url"),
        F.lit("info").alias("severity"),
        F.lit("subdomain_discovered").alias("finding_type"),
        F.concat(F.lit("Subdomain found: "), sub).alias("title"),
        F.lit("Named in certificate transparency logs; check that it is still in use").alias("description"),
        sub.alias("evidence"),
        F.lit(None).cast("int").alias("line_number"),
    )


def ct_subdomains(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """Findings per domain of ``entries`` (domain, name_value)."""
    return subdomain_findings(subdomain_names(entries), limit)


def name_suffixes(feed: DataFrame) -> DataFrame:
    """(subdomain, domain): every name of a feed (name_value) with each of its label suffixes but itself."""
    names = feed.select(F.explode(_names(F.col("name_value"))).alias("subdomain")).filter(
        F.contains("subdomain", F.lit("."))
    ).distinct()
    labels = F.split("subdomain", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(2), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    return names.select("subdomain", F.explode(suffixes).alias("domain"))


def _bits(domain: Column, size: int) -> list[Column]:
    """The bits of a Bloom filter of ``size`` bits that stand for a domain."""
    return [F.pmod(F.xxhash64(F.lit(k), domain), F.lit(size)) for k in range(BLOOM_HASHES)]


def likely_targets(suffixes: DataFrame, targets: DataFrame) -> DataFrame:
    """The suffixes that pass a Bloom filter of the targets' domains: all that are targets and few others.

    The filter is a table of 64-bit words, whose number is bounded, so it may be broadcast: nothing is shuffled here, and suffixes
    like ``com``, of which a feed has as many as names, go before any exchange.  With more targets than the largest filter serves
    the suffixes stay as they are.
    """
    domains = materialize(targets.select("domain").filter("domain IS NOT NULL").distinct())
    n = domains.count()
    if n * BLOOM_BITS > BLOOM_MOST_BITS:
        return suffixes
    size = 1 << max(10, (n * BLOOM_BITS - 1).bit_length())
    bit = F.explode(F.array(*_bits(F.col("domain"), size))).alias("bit")
    words = domains.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    words = F.broadcast(materialize(words))
    for bit in _bits(F.col("domain"), size):
        known = words.select(F.col("word").alias("__word"), F.col("bits").alias("__bits"))
        hit = F.getbit(F.col("__bits"), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
        suffixes = suffixes.join(known, (F.shiftright(bit, 6) == F.col("__word")) & hit, "left_semi")
    return suffixes


def ct_match_targets(feed: DataFrame, targets: DataFrame) -> DataFrame:
    """Match a whole feed (name_value) with a target list: distinct (domain, subdomain).

    Every name is joined on each of its label suffixes, an equi-join, where testing names against
    domains with ``endswith`` would compare all pairs.  Matches end on a label.
    """
    likely = likely_targets(name_suffixes(feed), targets)
    return likely.join(targets.select("domain"), "domain", "left_semi").select("domain", "subdomain")
