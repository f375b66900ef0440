from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import functions as F

from webposture import schemas
from webposture.functions import html
from webposture.functions import urls as U
from webposture.operators import links


def resolve(spark, pairs):
    df = spark.createDataFrame([("s", b, i, h) for i, (b, h) in enumerate(pairs)], "scan_id string, src_url string, pos int, href string")
    found = {r.pos: r.dst_url for r in links.resolve_links(df).collect()}
    return [found.get(i) for i in range(len(pairs))]


BASE = "https://example.com/a/b/c?q=1#f"
CASES = [
    ("/about", "https://example.com/about"),
    ("contact", "https://example.com/a/b/contact"),
    ("./x/../y", "https://example.com/a/b/y"),
    ("../../../../z", "https://example.com/z"),
    ("%2e%2E/z", "https://example.com/a/z"),
    ("..", "https://example.com/a/"),
    (".", "https://example.com/a/b/"),
    ("?x=ä'", "https://example.com/a/b/c?x=%C3%A4%27"),
    ("", "https://example.com/a/b/c?q=1"),
    ("//Other.ORG/x", "https://other.org/x"),
    ("\\\\other.org\\x?a\\b", "https://other.org/x?a\\b"),
    ("https:rel", "https://example.com/a/b/rel"),
    ("http:rel", "http://rel/"),
    ("HTTP://E.com:80/x", "http://e.com/x"),
    ("https://e.com:443", "https://e.com/"),
    ("https://e.com:8443/x#y z", "https://e.com:8443/x#y%20z"),
    ("https://e.com:99999/", None),
    ("https://e.com:x/", None),
    ("https://a b.com/", None),
    ("https://", None),
    ("https://[::1]:80/x", "https://[::1]:80/x"),
    ("https://h%41.com/", "https://ha.com/"),
    ("https://u:p@e.com/", "https://u:p@e.com/"),
    ("ftp://e.com/", None),
    ("javascript:x", None),
    ("a\n b\t", "https://example.com/a/b/a%20b"),
    ("/è ê", "https://example.com/%C3%A8%20%C3%AA"),
    ("/a\"<>`{}|^[]'", "https://example.com/a%22%3C%3E%60%7B%7D|^[]'"),
    ("/%zz%20", "https://example.com/%zz%20"),
    ("/😀", "https://example.com/%F0%9F%98%80"),
    ("/a//b/./c/..", "https://example.com/a//b/"),
]


def test_resolution(spark):
    got = resolve(spark, [(BASE, h) for h, _ in CASES])
    assert got == [want for _, want in CASES]


def test_resolution_agrees_with_the_standard_library(spark):
    bases = ["https://h.com/", "https://h.com/a", "https://h.com/a/b/?q", "https://h.com/a/b/c.html"]
    refs = ["x", "x/y", "/x", "?y", "x?y#z", "../x", "./x", "../../x/./y/../z", "//g", "g/", ".././g", "g;x=1/../y", "http://k.com/l"]
    pairs = [(b, r) for b in bases for r in refs]
    want = [urljoin(b, r) if r != "//g" else "https://g/" for b, r in pairs]
    assert resolve(spark, pairs) == want


def test_keys(spark):
    u = F.col("u")
    df = spark.createDataFrame([("https://e.com:8443/Page/?a=1#x#y",)], "u string")
    row = df.select(U.strip_fragment(u), U.origin_of(u), U.host_of(u), U.path_of(u)).first()
    assert tuple(row) == ("https://e.com:8443/Page/?a=1", "https://e.com", "e.com", "/Page/")


def test_with_scheme(spark):
    df = spark.createDataFrame([("e.com",), ("http://e",), ("https://e",), ("HTTP://e",)], "u string")
    assert [r[0] for r in df.select(U.with_scheme(F.col("u"))).collect()] == ["https://e.com", "http://e", "https://e", "https://HTTP://e"]


HREFS = [
    ('<p><a href="http://shop.test/cart?n=3">Cart</a>, <a class=k href="http://shop.test:81/">home</a>', ["http://shop.test/cart?n=3", "http://shop.test:81/"]),
    ('<a href="../up">u</a><a href="faq/en">f</a>', ["../up", "faq/en"]),
    ("<a href='x'>", ["x"]),
    ("<A HREF=x/y?a=b>", ["x/y?a=b"]),
    ('<a title=">" href="x">', ["x"]),
    ('<a title="<!--" href="x">', ["x"]),
    ('<a href="x" href="y">', ["x"]),
    ('<a data-href="y" href = "x">', ["x"]),
    ('<a id=top class="x y">top</a>', []),
    ("", []),
    ('<!-- <a href="x"> --><a href="y">', ["y"]),
    ('<!--><a href="y">', ["y"]),
    ('<script>var s = \'<a href="x">\';</script><a href="y">', ["y"]),
    ('<STYLE><a href="x"></style ><a href="y">', ["y"]),
    ('<title><a href="x"></title><textarea><a href="z"></textarea><noscript><a href="w"></noscript><a href="y">', ["y"]),
    ('<img alt="<a href=x>"><a href="y">', ["y"]),
    ('<abbr href="x"><area href="z"><a/href="y">', ["y"]),
    ('<a href="x', []),
    ('<a href="?a=1&amp;b=2&copy=3&lt;&#x41;&#66;&#128;&notit;&bogus;&amp">', ["?a=1&b=2&copy=3<AB€&notit;&bogus;&"]),
    ('<a href="  /t  ">', ["/t"]),
    ('<a href=""><a href="data:,q"><a href="#"><a href="tel:117"><a href><a href="javascript:go()"><a href="mailto:a@b.test"><a href="k.html">', ["k.html"]),
    ('<plaintext><a href="x">', []),
]


def pages(spark, bodies):
    rows = [("s", f"https://e.com/{i}", 200, [("content-type", "text/html")], b, None, None, None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, schemas.RESPONSES)


def test_hrefs(spark):
    found = {}
    for r in links.extract_links(pages(spark, [h for h, _ in HREFS])).orderBy("src_url", "pos").collect():
        found.setdefault(int(r.src_url.rsplit("/", 1)[1]), []).append(r.href)
    assert [found.get(i, []) for i in range(len(HREFS))] == [want for _, want in HREFS]


def test_links_only_from_html(spark):
    df = pages(spark, ['<a href="x">']).withColumn("headers", F.transform("headers", lambda h: h.withField("value", F.lit("Text/HTML"))))
    assert links.extract_links(df).count() == 0


def test_hostile_html_neither_overflows_nor_stalls(spark):
    bodies = ["<a " + "x=\"1\" y='2' = z " * 100_000 + ">", "<!--" + "-x" * 500_000, "<" * 500_000, '<a href="' + "../" * 3_000 + 'x">',
              '<a href="a' + " " * 500_000 + 'b">', "<a <a <script <!" * 100_000, '<a href="' + "&amp" * 200_000]
    assert links.page_links(pages(spark, bodies)).count() == 2


def test_numeric_references(spark):
    df = spark.createDataFrame([("&#0;&#x110000;&#xD800;&#99999999999;&#x1F600;&#x;",)], "t string")
    assert df.select(html.decode_references(F.col("t"))).first()[0] == "�" * 4 + "😀&#x;"


def test_same_host_is_exact(spark):
    rows = [("s", "https://e.com/", i, u) for i, u in enumerate(["https://e.com/x", "https://www.e.com/", "http://e.com:81/", "https://e.com.org/"])]
    df = spark.createDataFrame(rows, "scan_id string, src_url string, pos int, dst_url string")
    assert sorted(r.pos for r in links.same_host_links(df).collect()) == [0, 2]


def test_bodies_are_tokenized_once(spark):
    found = links.page_links(pages(spark, ['<a href="x">']))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("textarea") == 1


def test_url_in_normal_form_is_what_parsing_gives(spark):
    tails = ["", "/", "/a", "//", "/a//b/", "/.", "/..", "/.env", "/a/.", "/a/../b", "/a/..b", "/%2e", "/%2E%2e/x", "/%2efoo", "/.%2e?q", "/a\\b", "/a b", "/ä",
             "/`", "/{x}", "/|^[]", "?q", "/?q='", "/?q=`{}", "/?a/../b", "/?q#f", "/#f`", "/#a#b", "/#{x}", "/a\tb", "/\x7f", "/?\"", "/<", ";p", "/;p=1,2"]
    sites = ["https://e.com", "http://e.com", "https://E.com", "HTTP://e.com", "https://a.b.c-d_e", "https://e.com.", "https://.e", "https://a..b", "https://1.2", "https://1.2.3.4",
             "https://0x7f", "https://e.0x1", "https://e1", "https://1e", "https://-", "https://_x", "https://e.com:443", "https://e.com:8", "https://u@e.com", "https://", "https:///e.com",
             "https:e.com", "ftp://e.com", "https://[::1]", "https://xn--bcher-kva.de", "https://b\u00fccher.de", "https://%65.com", "https://e%", "e.com", " https://e.com", "https://\u4f8b\u3048.jp"]
    df = spark.createDataFrame([(s + t,) for s in sites for t in tails] + [(None,), ("",)], "u string")
    whole = {r.u: r.url for r in U.with_url_parts(df, "u").select("u", "parts.url").collect() if r.url is not None}
    quick = {r.u: r.url for r in U.normalized(df, "u", "url").collect()}
    assert quick == whole and len(quick) > 500
    assert df.filter(F.col("u").rlike(U._NORMAL)).count() > 90


def test_folder_above(spark):
    bases = ["https://e.com/", "https://e.com/a", "https://e.com/a/", "https://e.com/a/b?x/y#z/", "https://e.com/a//", "https://e.com/a/./b", "https://e.com/a/../b/c"]
    refs = ["../x", "../", "../../x/y", "..//x", "../?q", "../#f", "../x/../y", "../.x"]
    want = {"https://e.com/": "/", "https://e.com/a": "/", "https://e.com/a/": "/", "https://e.com/a/b?x/y#z/": "/", "https://e.com/a//": "/a/", "https://e.com/a/./b": "/",
            "https://e.com/a/../b/c": "/"}
    for ref in refs:
        above = {"../../x/y": ("/x/y", "/x/y"), "../x/../y": ("/y", "/a/y")}.get(ref, ("/" + ref[3:], "/a/" + ref[3:]))
        assert resolve(spark, [(b, ref) for b in bases]) == ["https://e.com" + above[want[b] == "/a/"] for b in bases], ref
