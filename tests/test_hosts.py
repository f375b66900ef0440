"""Host names of other scripts and numeric hosts, against the codec and the address classes of the standard library."""

from __future__ import annotations

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from webposture.functions import hosts
from webposture.functions import urls as U
from webposture.operators import links


def column(spark, function, values):
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in frame.select(function(F.col("v"))).collect()]


def test_punycode_of_samples(spark):
    # Names and their registered forms.
    names = {
        "bücher": "bcher-kva", "münchen": "mnchen-3ya", "faß": "fa-hia", "例え": "r8jz45g", "テスト": "zckzah",
        "παράδειγμα": "hxajbheg2az3al", "испытание": "80akhbyknj4f", "ü": "tda", "a😀b": "ab-no82a",
    }
    assert column(spark, hosts.punycode, names) == list(names.values())


def test_punycode_of_any_label(spark):
    draw = random.Random(11)
    ranges = [(0x61, 0x7A), (0xDF, 0xFF), (0x3B1, 0x3C9), (0x430, 0x44F), (0x4E00, 0x9FFF), (0x1F300, 0x1F5FF), (0x30, 0x39)]

    def label():
        chosen = draw.sample(ranges, draw.randint(1, 4))
        return "".join(chr(draw.randint(*draw.choice(chosen))) for _ in range(draw.randint(1, 60)))

    labels = [label() for _ in range(400)] + ["\U0010FFFF" * 3 + "a", "\x80", "ü" * 63, "a" * 62 + "\U0010FFFF"]
    assert column(spark, hosts.punycode, labels) == [x.encode("punycode").decode() for x in labels]


def test_names(spark):
    cases = {
        "BÜCHER.Example": "xn--bcher-kva.example", "xn--bcher-KVA.de": "xn--bcher-kva.de", "日本。jp": "xn--wgv71a.jp",
        "ｅｘ.com": "ex.com", "a­b​.ü.c": "ab.xn--tda.c", "plain.example": "plain.example", "": "", "ü..": "xn--tda..",
    }
    assert column(spark, hosts.ascii_name, cases) == list(cases.values())


def test_numeric_hosts(spark):
    cases = {
        "127.0.0.1": "127.0.0.1", "127.1": "127.0.0.1", "0x7f.1": "127.0.0.1", "0177.0.0.01": "127.0.0.1", "2130706433": "127.0.0.1",
        "0x7f000001": "127.0.0.1", "017700000001": "127.0.0.1", "1.2.3": "1.2.0.3", "1.2.3.4.": "1.2.3.4", "0": "0.0.0.0", "0x": "0.0.0.0",
        "4294967295": "255.255.255.255", "4294967296": None, "1.2.3.256": None, "1.256.1": None, "256.1.1.1": None, "1.2.65535": "1.2.255.255",
        "1.2.65536": None, "1.16777215": "1.255.255.255", "1.16777216": None, "1.2.3.4.5": None, "1..2": None, "09": None, "0x1g": "0x1g",
        "a.1": None, "a.0x": None, "1.a": "1.a", "0xffffffffffffffffffff": None, "000000000000000000001": "0.0.0.1", "a.b.1c": "a.b.1c",
    }
    assert column(spark, hosts.canonical_host, cases) == list(cases.values())


def test_ipv6(spark):
    draw = random.Random(7)
    good = ["::", "::1", "1::", "2001:DB8:0:0:0:0:0:1".lower(), "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "0:0:0:0:0:0:0:0",
            "1:2:3:4:5:6:1.2.3.4", "fe80::0:0:1", "1:0:3:0:5:0:7:0", "0001:00a0::"]
    for _ in range(200):
        groups = [draw.choice(["0", "0", "0", f"{draw.randrange(65536):x}", f"{draw.randrange(16):04x}"]) for _ in range(8)]
        good.append(":".join(groups))
    bad = ["", ":", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7::8", "::1.2.3", "::1.2.3.256", "::01.2.3.4", "1.2.3.4",
           "1:2:3:4:5:6:7:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::%eth0"]

    def short(text):
        groups = [f"{(int(ipaddress.IPv6Address(text)) >> s) & 0xFFFF:x}" for s in range(112, -1, -16)]
        runs = [(n, -i) for i in range(8) for n in range(2, 9 - i) if groups[i : i + n] == ["0"] * n]
        if not runs:
            return ":".join(groups)
        n, i = max(runs)
        return ":".join(groups[:-i]) + "::" + ":".join(groups[-i + n :])

    assert column(spark, hosts.ipv6, good) == [short(x) for x in good]
    assert column(spark, hosts.ipv6, bad) == [None] * len(bad)


@pytest.mark.parametrize(("url", "want"), [
    ("https://BÜcher.de/é", "https://xn--bcher-kva.de/%C3%A9"), ("https://b%C3%BCcher.de", "https://xn--bcher-kva.de/"),
    ("http://0x7F.1:80/a", "http://127.0.0.1/a"), ("http://u@[2001:DB8::0:1]:8080/", "http://u@[2001:db8::1]:8080/"),
    ("http://1.2.3.999/", None), ("http://[::g]/", None), ("http://[::1", None), ("https://日本。ＪＰ/", "https://xn--wgv71a.jp/"),
])
def test_urls(spark, url, want):
    frame = U.with_url_parts(spark.createDataFrame([(url,)], "u string"), "u")
    assert frame.select("parts.url").first()[0] == want


def test_two_spellings_are_one_host(spark):
    body = '<a href="https://xn--bcher-kva.de/a">1</a><a href="//BÜCHER.de/b">2</a><a href="https://buecher.de/c">3</a>'
    page = spark.createDataFrame([("s", "https://xn--bcher-kva.de/", 200, [("Content-Type", "text/html")], body)],
                                 "scan_id string, url string, status int, headers array<struct<name: string, value: string>>, body string")
    page = page.selectExpr("*", "cast(null as string) fetch_error")
    found = links.same_host_links(links.page_links(page)).collect()
    assert sorted(r.dst_url for r in found) == ["https://xn--bcher-kva.de/a", "https://xn--bcher-kva.de/b"]
