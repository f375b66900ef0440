from __future__ import annotations

from webposture import rules, schemas
from webposture.operators import ct, dns, tls


def dns_findings(spark, records, **options):
    """records: (owner, rrtype, rec_no, chunk_no, value) of d.com"""
    targets = spark.createDataFrame([("s", "d.com")], "scan_id string, domain string")
    table = spark.createDataFrame([("d.com", *r) for r in records], schemas.DNS_RECORDS)
    found = dns.dns_posture(targets, table, **options).collect()
    assert all(r.url == "dns://d.com" and r.scan_id == "s" and r.line_number is None for r in found)
    return {(r.title, r.severity, r.evidence) for r in found if r.title not in ("Missing CAA record", "DNSSEC not enabled")}


NO_SPF, NO_DMARC = ("Missing SPF record", "medium", ""), ("Missing DMARC record", "high", "")


def test_nothing_found(spark):
    targets = spark.createDataFrame([("s", "d.com")], "scan_id string, domain string")
    found = dns.dns_posture(targets, spark.createDataFrame([], schemas.DNS_RECORDS))
    assert {r.title for r in found.collect()} == {"Missing SPF record", "Missing DMARC record", "Missing CAA record", "DNSSEC not enabled"}


def test_all_in_order(spark):
    rows = [("d.com", "TXT", 0, 0, "v=spf1 -all"), ("_dmarc.d.com", "TXT", 0, 0, "v=DMARC1; p=reject"), ("d.com", "CAA", 0, 0, "x"), ("d.com", "DNSKEY", 0, 0, "x")]
    targets = spark.createDataFrame([("s", "d.com")], "scan_id string, domain string")
    assert dns.dns_posture(targets, spark.createDataFrame([("d.com", *r) for r in rows], schemas.DNS_RECORDS)).count() == 0


def test_chunks_join_in_order_and_first_record_counts(spark):
    rows = [
        ("d.com", "TXT", 12, 0, "v=spf1 -all"), ("d.com", "TXT", 3, 10, "~all"), ("d.com", "TXT", 3, 2, "pf1 "), ("d.com", "TXT", 3, 1, "v=s"),
        ("x.d.com", "TXT", 0, 0, "v=spf1 ?all"), ("d.com", "TXT", 0, 0, "V=SPF1 -all"),
    ]
    assert dns_findings(spark, rows) == {("Soft-fail SPF policy", "low", "v=spf1 ~all"), NO_DMARC}


def test_spf_policies(spark):
    for text, want in [("v=spf1 ?all", ("Weak SPF policy", "medium")), ("v=spf1 ~ALL -ALL", None), ("v=spf1 +all", ("Weak SPF policy", "medium")), ("v=spf1 a-all.com ?all", None)]:
        got = dns_findings(spark, [("d.com", "TXT", 0, 0, text)]) - {NO_DMARC}
        assert got == ({(*want, text)} if want else set())


def test_dmarc_policies(spark):
    monitor, quarantine = ("DMARC policy is monitor-only", "medium"), ("DMARC policy is quarantine (not reject)", "low")
    for text, want, strict in [
        ("v=DMARC1; P=None", monitor, monitor), ("v=DMARC1; p=quarantine", quarantine, quarantine), ("v=DMARC1; p=reject", None, None),
        ("v=DMARC1; p=reject; sp=none", monitor, None), ("v=DMARC1; p=quarantine; sp=none", monitor, quarantine),
    ]:
        rows = [("_dmarc.d.com", "TXT", 0, 0, text)]
        assert dns_findings(spark, rows) == {NO_SPF} | ({(*want, text)} if want else set())
        assert dns_findings(spark, rows, strict_dmarc=True) == {NO_SPF} | ({(*strict, text)} if strict else set())


NOW = 1_700_000_000
GOOD = "max-age=31536000; includeSubDomains"


def observe(spark, rows):
    """rows: (domain, tcp, handshake, protocol, seconds left, http, hsts)"""
    table = [(d, t, h, p, NOW + left, NOW, a, v) for d, t, h, p, left, a, v in rows]
    found = {}
    for r in tls.tls_posture(spark.createDataFrame(table, schemas.TLS_OBSERVATIONS)).collect():
        found.setdefault(r.url, set()).add((r.title, r.severity, r.evidence))
    return found


def test_tls(spark):
    far = 86400 * 90
    cases = {
        ("a.com", False, False, None, far, True, None): {("Port 443 unreachable", "medium", "")},
        ("b.com", True, False, None, far, True, None): {("TLS handshake failed", "high", "")},
        ("c.com", True, True, "TLSv1.3", far, True, GOOD): set(),
        ("d.com", True, True, "TLSv1.2", far, True, GOOD): {("TLS 1.3 not negotiated", "info", "TLSv1.2")},
        ("e.com", True, True, "TLSv1.1", far, True, GOOD): {("Obsolete TLS version", "critical", "Some(TLSv1_1)")},
        ("f.com", True, True, "QUIC", -86400, True, GOOD): {("TLS certificate expired", "critical", "1 days past expiry")},
        ("g.com", True, True, None, -86399, True, GOOD): {("TLS certificate expiring soon", "high", "0 days remaining")},
        ("h.com", True, True, "TLSv1.3", 14 * 86400, True, GOOD): {("TLS certificate expires within 30 days", "medium", "14 days remaining")},
        ("i.com", True, True, "TLSv1.3", 30 * 86400, True, GOOD): set(),
        ("j.com", True, True, "TLSv1.3", far, True, None): {("Missing HSTS header", "medium", "")},
        ("k.com", True, True, "TLSv1.3", far, False, None): set(),
        ("l.com", True, True, "TLSv1.3", far, True, "é"): {("HSTS missing includeSubDomains", "info", "")},
        ("not a name", False, False, None, far, True, None): set(),
        ("a.123", False, False, None, far, True, None): set(),
        ("-a.com", False, False, None, far, True, None): set(),
        ("10.0.0.256", False, False, None, far, True, None): set(),
        ("10.0.0.1", False, False, None, far, True, None): {("Port 443 unreachable", "medium", "")},
        ("_x.a-b.com", False, False, None, far, True, None): {("Port 443 unreachable", "medium", "")},
    }
    got = observe(spark, list(cases))
    assert got == {f"tls://{c[0]}:443": want for c, want in cases.items() if want}


def test_hsts_max_age(spark):
    from pyspark.sql import functions as F

    cases = {
        "max-age=100": 100, "includeSubDomains; Max-Age=\"15551999\"": 15551999, "max-age=abc; max-age=5": 5, "max-age= 5": None,
        "max-age=18446744073709551615": 18446744073709551615, "max-age=18446744073709551616": None, "max-age=+7": 7, "max-age=": None,
        "max-age=000000000000000000000000000009": 9, "max-age=-1": None, "max-age=99999999999999999999999; max-age=3": 3, "": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "v string").select(tls.hsts_max_age(F.col("v")))
    assert [None if r[0] is None else int(r[0]) for r in df.collect()] == list(cases.values())


def test_subdomains(spark):
    rows = [("example.com", "*.a.example.com\nB.Example.com\nexample.com\n\n *.*.c.example.com \nevilexample.com"), ("example.com", "a.example.com"), ("e.org", "www.other.net")]
    found = ct.ct_subdomains(spark.createDataFrame(rows, schemas.CT_ENTRIES)).collect()
    assert sorted(r.evidence for r in found) == ["a.example.com", "b.example.com", "c.example.com", "evilexample.com"]
    assert {(r.severity, r.finding_type, r.url == "https://" + r.evidence) for r in found} == {("info", "subdomain_discovered", True)}


def test_subdomain_limit_is_byte_order(spark):
    rows = [("e.com", "\n".join(f"{n}.e.com" for n in range(200)))]
    found = ct.ct_subdomains(spark.createDataFrame(rows, schemas.CT_ENTRIES), rules.MAX_SUBDOMAINS)
    assert sorted(r.evidence for r in found.collect()) == sorted(f"{n}.e.com" for n in range(200))[:50]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_feed_matches_end_on_a_label(spark):
    feed = spark.createDataFrame([("*.a.e.com\nevile.com\ne.com\nx.y.f.co.uk",)], "name_value string")
    targets = spark.createDataFrame([("1", "e.com"), ("2", "e.com"), ("3", "f.co.uk"), ("4", "co.uk")], "scan_id string, domain string")
    found = {tuple(r) for r in ct.ct_match_targets(feed, targets).collect()}
    assert found == {("e.com", "a.e.com"), ("f.co.uk", "x.y.f.co.uk"), ("co.uk", "x.y.f.co.uk")}


def test_a_filter_of_the_targets_before_the_exchange(spark):
    """Nearly all suffixes that are no target go before anything is shuffled, hot ones like "com" too."""
    feed = spark.range(3000).selectExpr("concat('a', id % 50, '.h', id, '.example.com') AS name_value").unionByName(
        spark.createDataFrame([("w.t7.net",), ("x.w.t7.net\nt8.net",)], "name_value string"))
    targets = spark.range(40).selectExpr("concat('t', id, '.net') AS domain")
    suffixes = ct.name_suffixes(feed)
    passed = ct.likely_targets(suffixes, targets)
    assert suffixes.count() > 9000 and passed.count() < 0.02 * suffixes.count()
    assert "ShuffledHashJoin" not in passed._jdf.queryExecution().executedPlan().toString()
    found = {tuple(r) for r in ct.ct_match_targets(feed, targets).collect()}
    assert found == {("t7.net", "w.t7.net"), ("t7.net", "x.w.t7.net")}


def test_more_targets_than_the_filter_serves(spark, monkeypatch):
    monkeypatch.setattr(ct, "BLOOM_MOST_BITS", 10)
    feed = spark.createDataFrame([("*.a.e.com\ne.com",)], "name_value string")
    targets = spark.createDataFrame([("e.com",), (None,), ("e.com",)], "domain string")
    assert [tuple(r) for r in ct.ct_match_targets(feed, targets).collect()] == [("e.com", "a.e.com")]
    assert ct.ct_match_targets(feed, targets.filter("false")).count() == 0
