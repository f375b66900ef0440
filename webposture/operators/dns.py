"""DNS posture: SPF, DMARC, CAA, DNSSEC.  One row per domain in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.operators.findings import emit, finding, present

_TYPE = "dns_misconfiguration"


def _unbound(key: str) -> Column:
    """A second grouping key that keeps the result from being partitioned by ``key`` alone.

    A later join on ``key`` then shuffles both sides, which lets Spark split a key that is hot on
    the other side; next to an aggregation it would not.
    """
    return F.xxhash64(key).alias("__unbound")


def txt_records(records: DataFrame) -> DataFrame:
    """TXT records with their chunks joined in order; chunks that are not UTF-8 are dropped.

    A group is one record, which the protocol limits to 64 KiB; chunks seen twice count once.
    """
    txt = records.filter(F.col("rrtype") == "TXT").filter(F.is_valid_utf8("value"))
    return txt.groupBy("domain", "owner", "rec_no").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_set(F.struct("chunk_no", "value"))), lambda c: c["value"]), ""
        ).alias("value")
    )


def domain_facts(records: DataFrame) -> DataFrame:
    """One row per domain with any record: what the four checks need to know.

    The two aggregations combine on the map side, so a domain with very many records does not
    pile up in one task.
    """
    apex = F.col("owner") == F.col("domain")
    mail = F.col("owner") == F.concat(F.lit("_dmarc."), F.col("domain"))
    texts = txt_records(records).select(
        "domain", "rec_no",
        (apex & F.col("value").startswith("v=spf1")).alias("is_spf"),
        (mail & F.col("value").startswith("v=DMARC1")).alias("is_dmarc"),
        apex.alias("apex_txt"), mail.alias("mail_txt"), "value",
        F.lit(False).alias("caa"), F.lit(False).alias("dnskey"),
    )
    others = records.filter(F.col("rrtype").isin("CAA", "DNSKEY") & apex).select(
        "domain", "rec_no",
        F.lit(False).alias("is_spf"), F.lit(False).alias("is_dmarc"),
        F.lit(False).alias("apex_txt"), F.lit(False).alias("mail_txt"), "value",
        (F.col("rrtype") == "CAA").alias("caa"), (F.col("rrtype") == "DNSKEY").alias("dnskey"),
    )
    # min_by takes the first record in answer order.
    facts = texts.unionByName(others).groupBy("domain", _unbound("domain")).agg(
        F.min_by("value", F.when(F.col("is_spf"), F.col("rec_no"))).alias("spf"),
        F.min_by("value", F.when(F.col("is_dmarc"), F.col("rec_no"))).alias("dmarc"),
        F.bool_or("apex_txt").alias("apex_txt"),
        F.bool_or("mail_txt").alias("mail_txt"),
        F.bool_or("caa").alias("caa"),
        F.bool_or("dnskey").alias("dnskey"),
    )
    return facts.drop("__unbound")


def _location() -> Column:
    return F.concat(F.lit("dns://"), F.col("domain"))


def _has(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def spf_finding() -> Column:
    spf, policy = F.col("spf"), F.lower("spf")
    strict, soft = F.contains(policy, F.lit("-all")), F.contains(policy, F.lit("~all"))
    url = _location()
    missing = F.when(_has("apex_txt"), F.lit("The domain has TXT records, but none starts with v=spf1")).otherwise(
        F.lit("The domain has no TXT records")
    )
    return (
        F.when(spf.isNull(), finding(url, "medium", _TYPE, "Missing SPF record", missing))
        .when(~strict & ~soft, finding(
            url, "medium", _TYPE, "Weak SPF policy", "The SPF record has neither -all nor ~all", spf))
        .when(soft & ~strict, finding(
            url, "low", _TYPE, "Soft-fail SPF policy", "The SPF record uses ~all instead of -all", spf))
    )


def dmarc_finding(strict: bool = False) -> Column:
    """``strict`` reads the tags; by default ``p=`` is searched in the text, so ``sp=none`` counts too."""
    dmarc, policy = F.col("dmarc"), F.lower("dmarc")
    if strict:
        monitor = policy.rlike(r"(^|;)\s*p\s*=\s*none\s*(;|\z)")
        quarantine = policy.rlike(r"(^|;)\s*p\s*=\s*quarantine\s*(;|\z)")
    else:
        monitor = F.contains(policy, F.lit("p=none"))
        quarantine = F.contains(policy, F.lit("p=quarantine"))
    url = _location()
    missing = F.when(_has("mail_txt"), F.lit("The _dmarc name has TXT records, but none starts with v=DMARC1")).otherwise(
        F.lit("The _dmarc name has no TXT records")
    )
    return (
        F.when(dmarc.isNull(), finding(url, "high", _TYPE, "Missing DMARC record", missing))
        .when(monitor, finding(
            url, "medium", _TYPE, "DMARC policy is monitor-only", "The DMARC policy p=none blocks nothing", dmarc))
        .when(quarantine, finding(
            url, "low", _TYPE, "DMARC policy is quarantine (not reject)",
            "The DMARC policy p=quarantine is weaker than p=reject", dmarc))
    )


def caa_finding() -> Column:
    return F.when(~_has("caa"), finding(
        _location(), "low", _TYPE, "Missing CAA record", "No CAA record restricts who may issue certificates"))


def dnssec_finding() -> Column:
    return F.when(~_has("dnskey"), finding(
        _location(), "low", _TYPE, "DNSSEC not enabled", "No DNSKEY record was found"))


def _check(targets: DataFrame, records: DataFrame, *findings: Column) -> DataFrame:
    return emit(targets.join(domain_facts(records), "domain", "left"), present(*findings))


def dns_spf(targets: DataFrame, records: DataFrame) -> DataFrame:
    return _check(targets, records, spf_finding())


def dns_dmarc(targets: DataFrame, records: DataFrame, strict: bool = False) -> DataFrame:
    return _check(targets, records, dmarc_finding(strict))


def dns_caa(targets: DataFrame, records: DataFrame) -> DataFrame:
    return _check(targets, records, caa_finding())


def dns_dnssec(targets: DataFrame, records: DataFrame) -> DataFrame:
    return _check(targets, records, dnssec_finding())


def dns_posture(targets: DataFrame, records: DataFrame, strict_dmarc: bool = False) -> DataFrame:
    """All DNS checks on ``targets`` (scan_id, domain)."""
    return _check(targets, records, spf_finding(), dmarc_finding(strict_dmarc), caa_finding(), dnssec_finding())
