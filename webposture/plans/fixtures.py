"""Input tables for the registered queries, derived from the driver's tables.

Nothing here belongs to the engine.  The driver's tables hold no findings as they stand, so
these statements plant some and build the collected-data tables around them.  The text is the
common subset of Spark SQL and DuckDB: both sides of a check start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webposture.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SQL = {}

SQL["responses_flat"] = """
SELECT doc_id AS resp_id,
  'h' || CAST(doc_id % 97 AS STRING) || '.example.com' AS target,
  'https://h' || CAST(doc_id % 97 AS STRING) || '.example.com' ||
    CASE doc_id % 41
      WHEN 0 THEN '/.env'            WHEN 1 THEN '/app/.git/config'
      WHEN 2 THEN '/robots.txt'      WHEN 3 THEN '/backup.sql?x=1'
      WHEN 4 THEN '/dump.sql'        WHEN 5 THEN '/.npmrc'
      WHEN 6 THEN '/.DS_Store'       WHEN 7 THEN '/server-status'
      WHEN 8 THEN '/my.env'          WHEN 9 THEN '/q?f=/.env'
      WHEN 10 THEN '/admin/x'        WHEN 11 THEN '/admin/public/y'
      WHEN 12 THEN '/.git/HEAD'      WHEN 13 THEN '/a/.htpasswd'
      WHEN 14 THEN '/wp-config.php'  WHEN 15 THEN '/.aws/credentials'
      WHEN 16 THEN '/.dockerenv'     WHEN 17 THEN '/docker-compose.yml'
      WHEN 18 THEN '/.htaccess'      WHEN 19 THEN '/phpinfo.php#top'
      WHEN 20 THEN '/elmah.axd'      WHEN 21 THEN '/crossdomain.xml'
      WHEN 22 THEN '/sitemap.xml'    WHEN 23 THEN '/.well-known/security.txt'
      WHEN 24 THEN ''                WHEN 25 THEN ':8443/.env'
      ELSE '/doc/' || CAST(doc_id AS STRING) END AS url,
  CAST(CASE doc_id % 10 WHEN 7 THEN 404 WHEN 9 THEN 500 ELSE 200 END AS INT) AS status,
  CASE doc_id % 7 WHEN 4 THEN NULL WHEN 5 THEN 'Text/HTML' WHEN 6 THEN 'application/json'
    ELSE 'text/html; charset=utf-8' END AS h_content_type,
  CASE doc_id % 5 WHEN 0 THEN 'Apache/2.4.41' WHEN 1 THEN 'cloudflare' ELSE NULL END AS h_server,
  CASE WHEN doc_id % 2 = 0 THEN 'default-src ''self''' ELSE NULL END AS h_csp,
  CASE WHEN doc_id % 3 = 0 THEN 'DENY' ELSE NULL END AS h_xfo,
  CASE WHEN doc_id % 4 = 0 THEN 'nosniff' ELSE NULL END AS h_xcto,
  CASE WHEN doc_id % 6 = 0 THEN 'max-age=31536000' ELSE NULL END AS h_sts,
  CASE WHEN doc_id % 8 = 0 THEN '1; mode=block' ELSE NULL END AS h_xxp,
  CASE WHEN doc_id % 9 = 0 THEN 'no-referrer' ELSE NULL END AS h_rp,
  CASE WHEN doc_id % 11 = 0 THEN '' ELSE NULL END AS h_pp,
  CAST(CASE doc_id % 31 WHEN 0 THEN 10485760 WHEN 1 THEN 10485761 WHEN 2 THEN NULL ELSE n_chars END AS BIGINT) AS content_length,
  CASE doc_id % 37 WHEN 3 THEN 'Request failed: timeout' ELSE NULL END AS fetch_error,
  text || chr(10) || CASE doc_id % 32
    WHEN 0 THEN 'id AKIA' || upper(substr(k, 1, 16)) || ' end'
    WHEN 1 THEN 'aws_secret_access_key = ' || k || substr(k, 1, 8)
    WHEN 2 THEN 't ghp_' || k || substr(k, 1, 6)
    WHEN 3 THEN '-----BEGIN RSA PRIVATE ' || 'KEY-----'
    WHEN 4 THEN 'sk_' || 'live_' || k
    WHEN 5 THEN 'SG.' || substr(k, 1, 22) || '.' || k || substr(k, 1, 11)
    WHEN 6 THEN 'AIza' || k || 'a-_'
    WHEN 7 THEN 'xoxb-' || substr(k, 1, 12)
    WHEN 8 THEN 'https://hooks.slack.com/services/T' || upper(substr(k, 1, 8)) || '/B' || upper(substr(k, 9, 9)) || '/' || substr(k, 1, 24)
    WHEN 9 THEN 'key-' || k || chr(13) || chr(10) || 'SK' || k
    WHEN 10 THEN 'SK' || k
    WHEN 11 THEN 'HEROKU_KEY=' || substr(k, 1, 8) || '-' || substr(k, 9, 4) || '-' || substr(k, 13, 4) || '-' || substr(k, 17, 4) || '-' || substr(k, 21, 12)
    WHEN 12 THEN 'postgres://u:' || substr(k, 1, 8) || '@db.example.com/x'
    WHEN 13 THEN 'eyJ' || substr(k, 1, 12) || '.' || substr(k, 1, 14) || '.' || substr(k, 3, 16)
    WHEN 14 THEN 'password = "' || substr(k, 1, 12) || '"'
    WHEN 15 THEN 'password = "short"'
    WHEN 16 THEN 'AKIA123'
    WHEN 17 THEN 'api_key: ''AKIA' || upper(substr(k, 1, 16)) || '''  AKIA' || upper(substr(k, 5, 16))
    ELSE '' END AS body
FROM (SELECT *, md5(CAST(doc_id AS STRING)) AS k FROM documents) d
"""

# Hosts past the customer range have no robots file at all.
SQL["robots_files"] = """
SELECT 'https://h' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 97 < 90 THEN '' ELSE '.none' END || '.example.com' AS origin,
  CAST(CASE WHEN c_custkey % 13 = 12 THEN 404 WHEN c_custkey % 29 = 28 THEN NULL ELSE 200 END AS INT) AS status,
  CASE c_custkey % 6
    WHEN 0 THEN 'User-agent: *' || chr(10) || 'Disallow: /admin/' || chr(10) || 'Allow: /admin/public/'
    WHEN 1 THEN 'User-agent: Googlebot' || chr(10) || 'Disallow: /doc/' || chr(10) || chr(10) || 'USER-AGENT: *' || chr(10) || 'disallow: /.env'
    WHEN 2 THEN '# all' || chr(10) || 'User-agent: *' || chr(10) || 'Disallow:' || chr(10) || 'Disallow: /'
    WHEN 3 THEN 'User-agent: *' || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /'
    WHEN 4 THEN 'User-agent: *' || chr(13) || chr(10) || 'Disallow: /doc/1' || chr(10) || 'Allow: /doc/1'
    ELSE '' END AS content
FROM customer
"""

SQL["dns_targets"] = """
SELECT 's' || CAST(c_custkey AS STRING) AS scan_id, 'd' || CAST(c_custkey AS STRING) || '.example.com' AS domain
FROM customer
"""

SQL["dns_records"] = """
SELECT domain, owner, rrtype, CAST(rec_no AS INT) AS rec_no, CAST(chunk_no AS INT) AS chunk_no, value
FROM (
  SELECT domain, domain AS owner, 'TXT' AS rrtype, 0 AS rec_no, 0 AS chunk_no,
    CASE WHEN k % 8 < 7 THEN 'site-verification=1' END AS value FROM d
  UNION ALL
  SELECT domain, domain, 'TXT', 1, 0, CASE WHEN k % 8 < 6 THEN
    CASE k % 3 WHEN 0 THEN 'v=spf1 include:a ' WHEN 1 THEN 'v=spf1 mx ' ELSE 'V=SPF1 -all ' END END FROM d
  UNION ALL
  SELECT domain, domain, 'TXT', 1, 1, CASE WHEN k % 8 < 6 THEN
    CASE k % 5 WHEN 0 THEN '-all' WHEN 1 THEN '~all' WHEN 2 THEN '~ALL -all' ELSE '?all' END END FROM d
  UNION ALL
  SELECT domain, domain, 'TXT', 2, 0, CASE WHEN k % 8 < 3 THEN 'v=spf1 second -all' END FROM d
  UNION ALL
  SELECT domain, '_dmarc.' || domain, 'TXT', 0, 0, CASE k % 7
    WHEN 0 THEN 'v=DMARC1; p=none' WHEN 1 THEN 'v=DMARC1; p=quarantine' WHEN 2 THEN 'v=DMARC1; p=reject'
    WHEN 3 THEN 'v=DMARC1; p=reject; sp=none' WHEN 4 THEN 'v=DMARC1; P=NONE' WHEN 5 THEN 'unrelated' END FROM d
  UNION ALL
  SELECT domain, domain, 'CAA', 0, 0, CASE WHEN k % 4 = 0 THEN '0 issue "ca.example"' END FROM d
  UNION ALL
  SELECT domain, domain, 'DNSKEY', 0, 0, CASE WHEN k % 9 = 0 THEN '257 3 13 x' END FROM d
) r
WHERE value IS NOT NULL
"""
_DOMAINS = "(SELECT c_custkey AS k, 'd' || CAST(c_custkey AS STRING) || '.example.com' AS domain FROM customer) d"
SQL["dns_records"] = SQL["dns_records"].replace("FROM d\n", f"FROM {_DOMAINS}\n")

SQL["tls_observations"] = """
SELECT 'd' || CAST(c_custkey AS STRING) || '.example.com' AS domain,
  (c_custkey % 17 <> 0) AS tcp_ok,
  (c_custkey % 17 <> 0 AND c_custkey % 19 <> 0) AS handshake_ok,
  CASE c_custkey % 5 WHEN 0 THEN 'TLSv1.2' WHEN 1 THEN 'TLSv1.1' WHEN 2 THEN 'TLSv1.0' ELSE 'TLSv1.3' END AS protocol,
  CAST(1700000000 + CASE c_custkey % 8 WHEN 0 THEN -864000 WHEN 1 THEN -1000 WHEN 2 THEN 1209599 WHEN 3 THEN 1209600
    WHEN 4 THEN 2591999 WHEN 5 THEN 2592000 WHEN 6 THEN -86400 ELSE 9000000 END AS BIGINT) AS not_after_epoch,
  CAST(1700000000 AS BIGINT) AS observed_epoch,
  (c_custkey % 23 <> 0) AS http_ok,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'max-age=31536000; includeSubDomains' WHEN 2 THEN 'max-age=100'
    WHEN 3 THEN 'includeSubDomains; Max-Age="15551999"' WHEN 4 THEN 'max-age=15552000' WHEN 5 THEN 'max-age=abc; max-age=5'
    WHEN 6 THEN 'max-age= 5' WHEN 7 THEN 'max-age=99999999999999999999999' ELSE 'includesubdomains' END AS hsts
FROM customer
"""

SQL["ct_entries"] = """
SELECT 'd' || CAST(l_suppkey AS STRING) || '.example.com' AS domain,
  CASE l_partkey % 6
    WHEN 0 THEN '*.w' || CAST(l_partkey % 211 AS STRING) || '.d' || CAST(l_suppkey AS STRING) || '.example.com'
    WHEN 1 THEN 'A' || CAST(l_partkey % 97 AS STRING) || '.D' || CAST(l_suppkey AS STRING) || '.Example.com' || chr(10) || 'd' || CAST(l_suppkey AS STRING) || '.example.com'
    WHEN 2 THEN ' *.*.deep.d' || CAST(l_suppkey AS STRING) || '.example.com ' || chr(10) || ''
    WHEN 3 THEN 'evild' || CAST(l_suppkey AS STRING) || '.example.com'
    WHEN 4 THEN 'www.unrelated.example.org'
    ELSE 'm' || CAST(l_partkey AS STRING) || '.d' || CAST(l_suppkey AS STRING) || '.example.com' END AS name_value
FROM lineitem
"""

# Every customer is a scan with its own visited set; links carry fragments, repeats and other hosts.
SQL["crawl_seeds"] = """
SELECT CAST(c_custkey AS STRING) AS scan_id, 'https://site.example.com/p/' || CAST(c_custkey AS STRING) AS target_url
FROM customer
"""

SQL["crawl_edges"] = """
SELECT 'https://site.example.com/p/' || CAST(o_orderkey AS STRING) AS src_url,
  CASE WHEN (o_orderkey + k) % 10 = 9 THEN 'https://other.example.org/p/' ELSE 'https://site.example.com/p/' END
    || CAST((o_orderkey * 3 + k) % 5003 AS STRING) || CASE WHEN k = 2 THEN '#frag' ELSE '' END AS dst_url,
  CAST(k AS INT) AS pos
FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(k)
"""

# Every customer is a site whose pages are its orders; a page links to the next two, and the
# third page is blocked, the fifth too large, the seventh a failed fetch.
SQL["site_pages"] = """
SELECT 's' || CAST(o_custkey AS STRING) AS scan_id,
  'https://c' || CAST(o_custkey AS STRING) || '.example.com/' || CASE WHEN n = 1 THEN '' WHEN n % 9 = 3 THEN 'private/' || CAST(o_orderkey AS STRING) ELSE 'o/' || CAST(o_orderkey AS STRING) END AS url,
  CAST(CASE WHEN n % 4 = 0 THEN 404 ELSE 200 END AS INT) AS status,
  CASE WHEN n % 6 = 0 THEN 'application/json' ELSE 'text/html' END AS h_content_type,
  '<html><body><a href="/o/' || coalesce(CAST(next1 AS STRING), 'end') || '">1</a>' || chr(10) ||
    '<a class=x href=''../o/' || coalesce(CAST(next2 AS STRING), 'end') || '#f''>2</a> <a href="/private/' || coalesce(CAST(next2 AS STRING), 'end') || '">3</a>' || chr(10) ||
    '<a href="https://other.example.org/">4</a> password = "' || md5(CAST(o_orderkey AS STRING)) || '"</body></html>' AS body,
  CAST(CASE WHEN n % 9 = 5 THEN 20000000 ELSE NULL END AS BIGINT) AS content_length,
  CASE WHEN n % 9 = 7 THEN 'Request failed: timeout' ELSE NULL END AS fetch_error,
  o_orderdate AS fetched_at
FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n,
    lead(o_orderkey, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next1,
    lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next2
  FROM orders) o
"""

SQL["site_targets"] = """
SELECT 's' || CAST(c_custkey AS STRING) AS scan_id, 'https://c' || CAST(c_custkey AS STRING) || '.example.com/' AS target_url
FROM customer
"""

SQL["site_robots"] = """
SELECT 'https://c' || CAST(c_custkey AS STRING) || '.example.com' AS origin, CAST(200 AS INT) AS status,
  'User-agent: *' || chr(10) || 'Disallow: /private/' AS content
FROM customer
"""

SQL["request_log"] = """
SELECT CAST(user_id AS STRING) AS domain, ts, event_id AS seq FROM events
"""

SQL["scan_events"] = """
SELECT CAST(user_id AS STRING) AS scan_id, ts, event_id AS seq,
  CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status
FROM events
"""

SQL["page_responses"] = """
SELECT CAST(page_id AS STRING) AS scan_id, url, CAST(200 AS INT) AS status, 'text/html' AS h_content_type, html AS body
FROM pages
"""

# Targets as users type them: with and without scheme, in either case.
SQL["typed_targets"] = """
SELECT CAST(c_custkey AS STRING) AS scan_id,
  CASE c_custkey % 5 WHEN 0 THEN 'http://' WHEN 1 THEN 'https://' WHEN 2 THEN 'HTTPS://' WHEN 3 THEN 'ftp://' ELSE '' END
    || 'Shop' || CAST(c_custkey AS STRING) || '.Example.com' AS target_url
FROM customer
"""

# Every event is a sighting of one of the pages of a user's site.
SQL["url_sightings"] = """
SELECT CAST(user_id % 20 AS STRING) AS scan_id, 'https://u' || CAST(user_id AS STRING) || '.example.com/' || CAST(event_id % 7 AS STRING) ||
    CASE WHEN event_id % 3 = 0 THEN '#top' ELSE '' END AS url, ts AS seen_at
FROM events
"""

# URLs in the forms a collector meets: case, ports, dot segments, spaces, other scripts, numeric hosts.
SQL["raw_urls"] = """
SELECT o_orderkey AS url_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'HTTP://' WHEN 1 THEN 'https://' WHEN 2 THEN ' http:' || chr(92) || chr(92) ELSE 'https:/' END
  || CASE o_orderkey % 3 WHEN 1 THEN 'u:p@' ELSE '' END
  || CASE o_orderkey % 11
    WHEN 3 THEN 'BÜCHER.s' || CAST(o_custkey AS STRING) || '.Example'
    WHEN 5 THEN '例え.テスト。S' || CAST(o_custkey AS STRING)
    WHEN 6 THEN '0xC0.0250.' || CAST(o_custkey % 65536 AS STRING)
    WHEN 8 THEN '[2001:DB8:0:0:0:0:0:' || CAST(1 + o_custkey % 9999 AS STRING) || ']'
    WHEN 9 THEN '1.2.3.' || CAST(256 + o_custkey AS STRING)
    ELSE CASE o_orderkey % 3 WHEN 0 THEN 'Shop' WHEN 1 THEN 'shop' ELSE '' END || CAST(o_custkey AS STRING) || '.Example.com' END
  || CASE o_orderkey % 5 WHEN 0 THEN ':80' WHEN 1 THEN ':443' WHEN 2 THEN ':8080' WHEN 3 THEN ':99999' ELSE '' END
  || CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN '/a/./b/../c' WHEN 2 THEN '/è ê"' WHEN 3 THEN '/../%2E%2e/x/' WHEN 4 THEN '?q=a b''c' WHEN 5 THEN '#frag' ELSE '/p//q?x=1#y' END AS raw_url
FROM orders
"""

# A shop whose name is not in ASCII, linked in several spellings.
SQL["idn_pages"] = """
SELECT 's' || CAST(o_custkey AS STRING) AS scan_id,
  'https://xn--bcher-kva.s' || CAST(o_custkey AS STRING) || '.example/o/' || CAST(o_orderkey AS STRING) AS url,
  CAST(200 AS INT) AS status, 'text/html' AS h_content_type, CAST(NULL AS STRING) AS fetch_error,
  '<a href="https://BÜCHER.S' || CAST(o_custkey AS STRING) || '.Example/a">1</a> <a href="https://buecher.s' || CAST(o_custkey AS STRING) || '.example/b">2</a> ' ||
    '<a href="//b%C3%BCcher。s' || CAST(o_custkey AS STRING) || '.example/c/' || CAST(o_orderkey AS STRING) || '">3</a> <a href="http://0x7f.1/d">4</a>' AS body
FROM orders
"""

# Statements that make much of a narrow row and deal nothing out themselves: so many rows a task.
SPREAD = {"crawl_edges": 50_000, "idn_pages": 20_000}

_FLAT_HEADERS = {
    "h_content_type": "Content-Type",
    "h_server": "Server",
    "h_csp": "Content-Security-Policy",
    "h_xfo": "X-Frame-Options",
    "h_xcto": "x-content-type-options",
    "h_sts": "STRICT-TRANSPORT-SECURITY",
    "h_xxp": "X-XSS-Protection",
    "h_rp": "Referrer-Policy",
    "h_pp": "Permissions-Policy",
}


def bind(spark: SparkSession, name: str, **tables: DataFrame) -> DataFrame:
    """Run fixture statement ``name`` on the given driver tables."""
    sql = SQL[name]
    for table in tables:
        sql = sql.replace(f"FROM {table}", f"FROM {{{table}}}")
    return spark.sql(sql, **tables)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a fixture built on it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needed = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in SQL[name]}
    if name in SPREAD:
        needed = {t: spread(df, SPREAD[name]) for t, df in needed.items()}
    return bind(spark, name, **needed)


def with_headers(flat: DataFrame) -> DataFrame:
    """Fold the flat header columns into ``headers``, leaving out absent ones."""
    present = [c for c in _FLAT_HEADERS if c in flat.columns]
    pairs = [
        F.when(F.col(c).isNotNull(), F.struct(F.lit(_FLAT_HEADERS[c]).alias("name"), F.col(c).alias("value")))
        for c in present
    ]
    return flat.withColumn("headers", F.array_compact(F.array(*pairs))).drop(*present)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``responses`` contract on the whole ``documents`` table."""
    return with_headers(table(spark, sf_dir, "responses_flat")).withColumnRenamed("target", "scan_id")


def site_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_headers(table(spark, sf_dir, "site_pages"))


def idn_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_headers(table(spark, sf_dir, "idn_pages"))


def page_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_headers(table(spark, sf_dir, "page_responses"))
