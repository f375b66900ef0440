"""TLS posture: reachability, protocol version, certificate expiry, HSTS.

Narrow: every finding follows from one row of ``tls_observations``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture import rules
from webposture.functions.text import trim_space
from webposture.operators.findings import emit, finding, present

_TYPE = "tls_issue"
# A DNS name whose last label is not a number, or an IP address.
_SERVER_NAME = (
    r"^(?=.{1,253}\z)(?!(?:.*\.)?[0-9]+\.?\z)(?i:[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)"
    r"(?i:\.[a-z0-9_](?:[a-z0-9_-]{0,61}[a-z0-9_])?)*+\.?\z"
    r"|^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
    r"|^[0-9a-fA-F:]*:[0-9a-fA-F:.]+\z"
)


def _url() -> Column:
    return F.concat(F.lit("tls://"), F.col("domain"), F.lit(":443"))


def _checked() -> Column:
    """A domain that is no valid server name is not checked at all."""
    return F.col("domain").rlike(_SERVER_NAME)


def _shaken() -> Column:
    return _checked() & F.col("tcp_ok") & F.col("handshake_ok")


def connection_finding() -> Column:
    url = _url()
    return F.when(
        _checked() & ~F.col("tcp_ok"),
        finding(url, "medium", _TYPE, "Port 443 unreachable", "No TCP connection to port 443"),
    ).when(
        _checked() & ~F.col("handshake_ok"),
        finding(url, "high", _TYPE, "TLS handshake failed", "The TLS handshake did not complete"),
    )


def version_finding() -> Column:
    protocol = F.col("protocol")
    # Protocol names as collectors report them, and the evidence they lead to.
    evidence = F.when(protocol == "TLSv1.1", F.lit("Some(TLSv1_1)")).otherwise(F.lit("Some(TLSv1_0)"))
    url = _url()
    return F.when(
        _shaken() & (protocol == "TLSv1.2"),
        finding(url, "info", _TYPE, "TLS 1.3 not negotiated", "The server chose TLS 1.2", "TLSv1.2"),
    ).when(
        _shaken() & protocol.isin("TLSv1.1", "TLSv1.0"),
        finding(url, "critical", _TYPE, "Obsolete TLS version", "The server chose TLS 1.0 or 1.1", evidence),
    )


def expiry_finding() -> Column:
    # Integral division truncates toward zero: up to a day past expiry counts as 0 days left.
    days = F.expr("(not_after_epoch - observed_epoch) div 86400")
    left = F.concat(days.cast("string"), F.lit(" days remaining"))
    past = F.concat((-days).cast("string"), F.lit(" days past expiry"))
    url = _url()
    return F.when(_shaken(), F.when(
        days < 0, finding(url, "critical", _TYPE, "TLS certificate expired", "The certificate is out of date", past)
    ).when(
        days < rules.EXPIRY_HIGH_DAYS,
        finding(url, "high", _TYPE, "TLS certificate expiring soon", "The certificate ends within 14 days", left),
    ).when(
        days < rules.EXPIRY_MEDIUM_DAYS,
        finding(url, "medium", _TYPE, "TLS certificate expires within 30 days",
                "The certificate ends within 30 days", left),
    ))


def hsts_value() -> Column:
    """The header text; one that is not visible ASCII reads as empty."""
    hsts = F.col("hsts")
    return F.when(hsts.isNotNull(), F.when(hsts.rlike(r"^[\x20-\x7e\t]*\z"), hsts).otherwise(""))


def hsts_max_age(value: Column) -> Column:
    """First ``max-age`` part that reads as an unsigned 64-bit number, else NULL."""
    parts = F.transform(F.split(F.lower(value), ";", -1), trim_space)
    digits = F.transform(
        parts,
        lambda p: F.regexp_replace(F.regexp_extract(p, r'^max-age="*+\+?([0-9]++)"*+\z', 1), r"^0++(?=.)", ""),
    )
    ages = F.transform(
        F.filter(digits, lambda d: (d != "") & (F.length(d) <= 20)), lambda d: d.try_cast("decimal(20,0)")
    )
    return F.try_element_at(F.filter(ages, lambda a: a <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.lit(1))


def hsts_findings() -> tuple[Column, Column, Column]:
    value = hsts_value()
    answered = _shaken() & F.col("http_ok")
    url = _url()
    return (
        F.when(answered & value.isNull(), finding(
            url, "medium", _TYPE, "Missing HSTS header", "The site does not send Strict-Transport-Security")),
        F.when(answered & (hsts_max_age(value) < rules.HSTS_MIN_AGE), finding(
            url, "low", _TYPE, "HSTS max-age below 6 months", "HSTS holds for less than 15552000 seconds", value)),
        F.when(answered & ~F.contains(F.lower(value), F.lit("includesubdomains")), finding(
            url, "info", _TYPE, "HSTS missing includeSubDomains", "HSTS does not cover subdomains", value)),
    )


def tls_connection(observations: DataFrame) -> DataFrame:
    return emit(observations, present(connection_finding()))


def tls_version(observations: DataFrame) -> DataFrame:
    return emit(observations, present(version_finding()))


def tls_expiry(observations: DataFrame) -> DataFrame:
    return emit(observations, present(expiry_finding()))


def tls_hsts(observations: DataFrame) -> DataFrame:
    return emit(observations, present(*hsts_findings()))


def tls_posture(observations: DataFrame) -> DataFrame:
    """All TLS checks; ``observations`` may carry a scan_id."""
    return emit(observations, present(connection_finding(), version_finding(), expiry_finding(), *hsts_findings()))
