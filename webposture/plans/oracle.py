"""What the registered queries must return, in DuckDB SQL, written apart from the operators.

Only the fixture statements and the rule texts are shared with the Spark side.
"""

from __future__ import annotations

from webposture import rules
from webposture.plans.fixtures import SQL

ORACLE: dict[str, str] = {}

# The detector patterns in the syntax of linear-time engines, in registry order.
PATTERNS = (
    r"AKIA[0-9A-Z]{16}",
    r"aws_secret_access_key\s*=\s*[A-Za-z0-9/+=]{40}",
    r"ghp_[a-zA-Z0-9]{36,40}",
    r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"[sr]k_(live|test)_[0-9a-zA-Z]{24,}",
    r"SG\.[0-9A-Za-z\-_]{22}\.[0-9A-Za-z\-_]{43}",
    r"AIza[0-9A-Za-z\-_]{35}",
    r"xox[baprs]-[0-9a-zA-Z\-]{10,48}",
    r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[a-zA-Z0-9]{24}",
    r"key-[0-9a-zA-Z]{32}",
    r"SK[0-9a-fA-F]{32}",
    r"(?i)heroku.*[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"""(?i)(postgres|mysql|mongodb|redis|amqp)(\+\w+)?://[^\s<>"']{10,}""",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"""(?i)(password|passwd|secret|api_key|apikey|access_key|auth_token|private_key)\s*[=:]\s*['"][A-Za-z0-9/+=@\-_.!#$%]{8,}['"]""",
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def fixture(*names: str) -> str:
    return ", ".join(f"{n} AS ({SQL[n]})" for n in names)


def found(url: str, severity: str, kind: str, title: str, description: str, evidence: str = "''",
          line: str = "CAST(NULL AS INT)", scan: str = "scan_id, ") -> str:
    return (
        f"SELECT {scan}{url} AS url, {severity} AS severity, {lit(kind)} AS finding_type, {title} AS title, "
        f"{description} AS description, {evidence} AS evidence, {line} AS line_number"
    )


# Pages

def content(table: str, scan: str) -> str:
    branches = [
        f"SELECT {i} AS d, sid, url, line_number, regexp_extract(line, {lit(p)}) AS m FROM lines WHERE regexp_matches(line, {lit(p)})"
        for i, p in enumerate(PATTERNS)
    ]
    detectors = values("detectors", "d, severity, title, description",
                       [(i, d.severity, d.title, d.description) for i, d in enumerate(rules.DETECTORS)])
    return f"""{detectors},
lines AS (SELECT sid, url, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INT) AS line_number
  FROM (SELECT {scan} AS sid, url, string_split(body, chr(10)) AS ls FROM {table})),
hits AS ({' UNION ALL '.join(branches)}),
secrets AS ({found('url', 'severity', 'exposed_secret', 'title', 'description',
                   "CASE WHEN strlen(m) <= 8 THEN repeat('*', strlen(m)) ELSE left(m, 4) || '...' || right(m, 4) END",
                   'line_number', 'sid AS scan_id, ')} FROM hits JOIN detectors USING (d))"""


PATHS = values("paths", "p, severity, description", [(r.path, r.severity, r.description) for r in rules.SENSITIVE_PATHS])
FILES = f"""{PATHS}, files AS ({found(
    'url', 'severity', 'sensitive_file', "'Sensitive file accessible: ' || p", 'description',
    "'HTTP 200 returned for ' || p", scan='target AS scan_id, ')}
FROM fetched_flat, paths
WHERE status = 200 AND severity <> 'info' AND suffix(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), p))"""

HEADER_COLUMNS = ("h_csp", "h_xfo", "h_xcto", "h_sts", "h_xxp", "h_rp", "h_pp")
HEADERS = "headers AS (" + " UNION ALL ".join(
    found("url", lit(rule.severity), "missing_security_header", lit(f"Missing {rule.name} header"),
          lit(f"The response does not set {rule.name}"), lit(rules.HEADER_ABSENT), scan="target AS scan_id, ")
    + f" FROM fetched_flat WHERE status = 200 AND contains(h_content_type, 'text/html') AND {column} IS NULL"
    for rule, column in zip(rules.SECURITY_HEADERS, HEADER_COLUMNS)
) + ")"
SERVERS = f"""servers AS ({found('url', "'low'", 'information_disclosure', "'Server version disclosure'",
                                 "'The Server header tells the software and its version'", 'h_server',
                                 scan='target AS scan_id, ')}
FROM fetched_flat WHERE contains(h_server, '/'))"""
FLAT = fixture("responses_flat") + ",\nfetched_flat AS (SELECT * FROM responses_flat WHERE fetch_error IS NULL)"
SECRETS = content("fetched_flat", "target")
ALL_COLUMNS = "scan_id, url, severity, finding_type, title, description, evidence, line_number"
PAGE = f"""{FLAT}, {SECRETS}, {FILES}, {HEADERS}, {SERVERS},
page_findings AS (SELECT * FROM secrets UNION ALL SELECT * FROM files UNION ALL SELECT * FROM headers UNION ALL SELECT * FROM servers)"""

ORACLE["page_lines"] = f"""WITH {FLAT}, l AS (
  SELECT target, url, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total
  FROM (SELECT target, url, string_split_regex(body, '\\r?\\n') AS ls FROM responses_flat))
SELECT target AS scan_id, url, CAST(n AS INT) AS line_number, line FROM l WHERE line <> '' OR n < total"""
ORACLE["scan_content"] = f"WITH {FLAT}, {SECRETS} SELECT * FROM secrets"
ORACLE["sensitive_files"] = f"WITH {FLAT}, {FILES} SELECT * FROM files"
ORACLE["missing_headers"] = f"WITH {FLAT}, {HEADERS} SELECT * FROM headers"
ORACLE["server_disclosure"] = f"WITH {FLAT}, {SERVERS} SELECT * FROM servers"
ORACLE["scan_page"] = f"WITH {PAGE} SELECT * FROM page_findings"
ORACLE["size_gate"] = f"""WITH {FLAT}
SELECT target AS scan_id, url,
  CASE WHEN fetch_error IS NOT NULL THEN fetch_error
    WHEN content_length > 10485760 THEN 'Response too large: ' || content_length || ' bytes' END AS error,
  CAST(CASE WHEN fetch_error IS NOT NULL OR content_length > 10485760 THEN 0 ELSE strlen(body) END AS BIGINT) AS bytes
FROM responses_flat"""

# URLs.  The raw URLs are built from cases of the key, and so are the expected parts.

ORACLE["url_parts"] = """WITH p AS (
  SELECT o_orderkey AS url_id,
    CASE o_orderkey % 4 WHEN 0 THEN 'http' WHEN 2 THEN 'http' ELSE 'https' END AS scheme,
    CASE WHEN o_orderkey % 3 = 1 THEN 'u:p@' ELSE '' END AS userinfo,
    CASE o_orderkey % 11 WHEN 3 THEN 'xn--bcher-kva.s' || o_custkey || '.example' WHEN 5 THEN 'xn--r8jz45g.xn--zckzah.s' || o_custkey
      WHEN 6 THEN '192.168.' || (o_custkey % 65536 // 256) || '.' || (o_custkey % 256) WHEN 8 THEN '[2001:db8::' || (1 + o_custkey % 9999) || ']'
      WHEN 9 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 'shop' WHEN 1 THEN 'shop' ELSE '' END || o_custkey || '.example.com' END AS host,
    CASE o_orderkey % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 99999 END AS typed_port,
    CASE o_orderkey % 7 WHEN 1 THEN '/a/c' WHEN 2 THEN '/%C3%A8%20%C3%AA%22' WHEN 3 THEN '/x/' WHEN 6 THEN '/p//q' ELSE '/' END AS path,
    CASE o_orderkey % 7 WHEN 4 THEN 'q=a%20b%27c' WHEN 6 THEN 'x=1' END AS query,
    CASE o_orderkey % 7 WHEN 5 THEN 'frag' WHEN 6 THEN 'y' END AS fragment
  FROM orders),
q AS (SELECT *, CAST(CASE WHEN typed_port <> CASE scheme WHEN 'http' THEN 80 ELSE 443 END THEN typed_port END AS INT) AS port,
  coalesce(typed_port, 0) <= 65535 AND host IS NOT NULL AS ok FROM p)
SELECT url_id,
  CASE WHEN ok THEN scheme || '://' || userinfo || host || coalesce(':' || port, '') || path || coalesce('?' || query, '') || coalesce('#' || fragment, '') END AS url,
  CASE WHEN ok THEN scheme END AS scheme, CASE WHEN ok THEN host END AS host, CASE WHEN ok THEN port END AS port,
  CASE WHEN ok THEN path END AS path, CASE WHEN ok THEN query END AS query, CASE WHEN ok THEN fragment END AS fragment
FROM q"""
ORACLE["normalize_target"] = f"""WITH {fixture('typed_targets')}
SELECT scan_id, CASE WHEN regexp_matches(target_url, '^https?://') THEN target_url ELSE 'https://' || target_url END AS target_url
FROM typed_targets"""
ORACLE["url_keys"] = f"""WITH {FLAT}
SELECT resp_id, regexp_replace(url, '#.*$', '') AS frontier_key, 'https://' || target AS origin,
  CASE WHEN regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) END AS path
FROM responses_flat"""

# Links

HREFS = """clean AS (SELECT CAST(page_id AS VARCHAR) AS scan_id, url AS src_url,
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'), '(?s)<style.*?</style>', '', 'g') AS html
  FROM pages),
hrefs AS (SELECT scan_id, src_url, unnest(hs) AS raw, CAST(generate_subscripts(hs, 1) - 1 AS INT) AS pos
  FROM (SELECT *, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hs FROM clean)),
links AS (SELECT scan_id, src_url, pos, replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS href
  FROM hrefs WHERE raw <> '' AND NOT regexp_matches(raw, '^(javascript:|mailto:|tel:|#|data:)'))"""
ORACLE["extract_links"] = f"WITH {HREFS} SELECT * FROM links"
ORACLE["resolve_links"] = f"""WITH {HREFS}
SELECT scan_id, src_url, pos, regexp_extract(src_url, '^https?://[^/]*') ||
  array_to_string(list_transform(string_split(href, ''), lambda c:
    CASE WHEN regexp_matches(c, '^[!$-;=@-_a-z|~]$') THEN c
      ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END), '') AS dst_url
FROM links WHERE href LIKE '/%'"""
SITE_LINKS = """folders AS (SELECT scan_id, url, regexp_extract(url, '^https://[^/]*') AS site,
    regexp_extract(body, 'href="/o/([^"]*)"', 1) AS next1, regexp_extract(body, 'o/([^#"]*)#f', 1) AS next2,
    status, h_content_type, content_length, fetch_error, fetched_at, body FROM site_pages),
site_links AS (
  SELECT scan_id, url AS src_url, 0 AS pos, site || '/o/' || next1 AS dst_url FROM folders WHERE h_content_type = 'text/html'
  UNION ALL SELECT scan_id, url, 1, site || '/o/' || next2 || '#f' FROM folders WHERE h_content_type = 'text/html'
  UNION ALL SELECT scan_id, url, 2, site || '/private/' || next2 FROM folders WHERE h_content_type = 'text/html')"""
SITES = f"{fixture('site_pages', 'site_targets')}, {SITE_LINKS}"
ORACLE["same_host_links"] = f"WITH {SITES} SELECT scan_id, src_url, CAST(pos AS INT) AS pos, dst_url FROM site_links"
ORACLE["idn_links"] = """WITH links AS (
  SELECT 's' || o_custkey AS scan_id, 'https://xn--bcher-kva.s' || o_custkey || '.example/' AS site, o_orderkey AS o FROM orders)
SELECT scan_id, site || 'o/' || o AS src_url, CAST(0 AS INT) AS pos, site || 'a' AS dst_url FROM links
UNION ALL SELECT scan_id, site || 'o/' || o, 2, site || 'c/' || o FROM links"""

# Frontier

ORACLE["seed_probes"] = f"""WITH {fixture('typed_targets')}, {values('paths', 'p, pos', [(r.path, i + 1) for i, r in enumerate(rules.SENSITIVE_PATHS)])}
SELECT scan_id, CASE CAST(scan_id AS INT) % 5 WHEN 0 THEN 'http://shop' || scan_id || '.example.com' WHEN 1 THEN 'https://shop' || scan_id || '.example.com'
    WHEN 2 THEN 'https://https' WHEN 3 THEN 'https://ftp' ELSE 'https://shop' || scan_id || '.example.com' END || p AS url,
  CAST(pos AS INT) AS pos
FROM typed_targets, paths"""
REACHED = f"""{fixture('crawl_seeds', 'crawl_edges')},
edges AS (SELECT src_url, regexp_replace(dst_url, '#.*$', '') AS dst_url, min(pos) AS pos FROM crawl_edges
  WHERE dst_url LIKE 'https://site.example.com/%' GROUP BY ALL),
walk(scan_id, url, depth) AS (
  SELECT scan_id, target_url, 0 FROM crawl_seeds
  UNION
  SELECT w.scan_id, e.dst_url, w.depth + 1 FROM walk w JOIN edges e ON e.src_url = w.url WHERE w.depth < {rules.DEFAULT_DEPTH}),
reached AS (SELECT scan_id, url, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY scan_id, url)"""
ORACLE["crawl_frontier"] = f"WITH RECURSIVE {REACHED} SELECT * FROM reached"
ORACLE["frontier_levels"] = f"WITH RECURSIVE {REACHED} SELECT scan_id, depth, count(*) AS urls FROM reached GROUP BY ALL"


def _level(n: int) -> str:
    """URLs first seen at depth n, with the queue number of the first parent and the link position."""
    earlier = " UNION ALL ".join(f"SELECT scan_id, url FROM q{i}" for i in range(n))
    return f"""c{n} AS (SELECT q.scan_id, e.dst_url AS url, min((q.no, e.pos)) AS k FROM q{n - 1} q JOIN edges e ON e.src_url = q.url GROUP BY ALL),
q{n} AS (SELECT scan_id, url, {n} AS depth, (SELECT max(no) FROM q{n - 1}) + row_number() OVER (PARTITION BY scan_id ORDER BY k) AS no
  FROM c{n} ANTI JOIN ({earlier}) seen USING (scan_id, url))"""


ORACLE["visit_order"] = f"""WITH RECURSIVE {REACHED},
q0 AS (SELECT scan_id, target_url AS url, 0 AS depth, 1 AS no FROM crawl_seeds),
{', '.join(_level(n) for n in range(1, rules.DEFAULT_DEPTH + 1))}
SELECT scan_id, url, CAST(depth AS INT) AS depth, row_number() OVER (PARTITION BY scan_id ORDER BY no) AS visit_no
FROM ({' UNION ALL '.join(f'SELECT * FROM q{n}' for n in range(rules.DEFAULT_DEPTH + 1))})"""

PLAN = f"""{SITES}, {PATHS},
good AS (SELECT DISTINCT l.scan_id, l.src_url, regexp_replace(l.dst_url, '#.*$', '') AS dst_url FROM site_links l
  JOIN folders f ON f.scan_id = l.scan_id AND f.url = l.src_url
  WHERE f.fetch_error IS NULL AND f.url NOT LIKE '%/private/%'),
walk(scan_id, url, depth) AS (
  SELECT scan_id, target_url, 0 FROM site_targets
  UNION SELECT scan_id, rtrim(target_url, '/') || p, 0 FROM site_targets, paths
  UNION SELECT w.scan_id, g.dst_url, w.depth + 1 FROM walk w JOIN good g ON g.scan_id = w.scan_id AND g.src_url = w.url
    WHERE w.depth < {rules.DEFAULT_DEPTH}),
plan AS (SELECT scan_id, url, CAST(min(depth) AS INT) AS depth, url NOT LIKE '%/private/%' AS allowed FROM walk GROUP BY scan_id, url)"""
ORACLE["crawl_plan"] = f"WITH RECURSIVE {PLAN} SELECT * FROM plan"

SITE_SECRETS = content("fetched", "scan_id")
SITE_FINDINGS = f"""{PLAN},
fetched AS (SELECT f.* FROM folders f JOIN plan p ON p.scan_id = f.scan_id AND p.url = f.url
  WHERE p.allowed AND f.fetch_error IS NULL),
{SITE_SECRETS}, {values('expected', 'name, sev', [(h.name, h.severity) for h in rules.SECURITY_HEADERS])},
site_findings AS (SELECT * FROM secrets UNION ALL {found(
    'url', 'sev', 'missing_security_header', "'Missing ' || name || ' header'",
    "'The response does not set ' || name", lit(rules.HEADER_ABSENT))}
  FROM fetched, expected WHERE status = 200 AND h_content_type = 'text/html')"""
ORACLE["site_findings"] = f"WITH RECURSIVE {SITE_FINDINGS} SELECT {ALL_COLUMNS} FROM site_findings"
INFO = """log AS (SELECT p.scan_id, p.allowed, f.fetched_at,
    NOT p.allowed OR f.fetch_error IS NOT NULL AS failed, strlen(f.body) AS size
  FROM plan p LEFT JOIN folders f ON p.scan_id = f.scan_id AND p.url = f.url WHERE f.url IS NOT NULL OR NOT p.allowed),
totals AS (SELECT scan_id, min(fetched_at) AS s, max(fetched_at) AS e, count(*) AS pages_crawled,
    count(*) FILTER (failed) AS errors, CAST(sum(CASE WHEN failed THEN 0 ELSE size END) AS BIGINT) AS bytes_downloaded FROM log GROUP BY scan_id),
accepted AS (SELECT scan_id, count(*) FILTER (depth > 0) AS urls_discovered FROM plan GROUP BY scan_id),
info AS (SELECT scan_id, target_url AS target,
  strftime(s, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS start_time, strftime(e, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS end_time,
  CAST((epoch_us(e) - epoch_us(s)) // 1000000 AS BIGINT) AS duration_seconds,
  coalesce(pages_crawled, 0) AS pages_crawled, coalesce(urls_discovered, 0) AS urls_discovered,
  coalesce(errors, 0) AS errors, coalesce(bytes_downloaded, 0) AS bytes_downloaded,
  round(coalesce(bytes_downloaded, 0) / 1048576.0::DOUBLE, 2) AS downloaded_mb
FROM site_targets LEFT JOIN totals USING (scan_id) LEFT JOIN accepted USING (scan_id))"""
ORACLE["scan_info"] = f"WITH RECURSIVE {PLAN}, {INFO} SELECT * FROM info"

# robots.txt

ROBOTS = f"""{fixture('robots_files')},
numbered AS (SELECT origin, unnest(ls) AS raw, generate_subscripts(ls, 1) AS n
  FROM (SELECT origin, string_split(content, chr(10)) AS ls FROM robots_files WHERE status BETWEEN 200 AND 299)),
trimmed AS (SELECT origin, n, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM numbered),
agents AS (SELECT *, last_value(CASE WHEN lower(line) LIKE 'user-agent:%' THEN trim(line[12:]) END IGNORE NULLS)
  OVER (PARTITION BY origin ORDER BY n) AS agent FROM trimmed),
kinds AS (SELECT origin, n, CASE WHEN lower(line) LIKE 'allow:%' THEN 'allow' WHEN lower(line) LIKE 'disallow:%' THEN 'disallow' END AS kind,
  trim(substr(line, strpos(line, ':') + 1)) AS prefix FROM agents WHERE agent = '*'),
robot_rules AS (SELECT origin, n, kind, prefix FROM kinds WHERE kind IS NOT NULL AND prefix <> '')"""
ORACLE["robots_rules"] = f"""WITH {ROBOTS}
SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY n) - 1 AS INT) AS pos, kind, prefix, CAST(strlen(prefix) AS INT) AS len
FROM robot_rules"""
JUDGED = """urls AS (SELECT resp_id, url, 'https://' || target AS origin, regexp_extract(url, '^https://[^/?#]*([^?#]*)', 1) AS rawpath FROM responses_flat),
pathed AS (SELECT resp_id, url, origin, CASE WHEN rawpath = '' THEN '/' ELSE rawpath END AS path FROM urls),
decided AS (SELECT resp_id, url,
    coalesce(max(strlen(prefix)) FILTER (kind = 'allow'), -1) >= coalesce(max(strlen(prefix)) FILTER (kind = 'disallow'), -1) AS allowed
  FROM pathed p LEFT JOIN robot_rules r ON r.origin = p.origin AND starts_with(p.path, r.prefix) GROUP BY resp_id, url)"""
DECIDED = f"{ROBOTS}, {FLAT}, {JUDGED}"
ORACLE["robots_decision"] = f"WITH {DECIDED} SELECT * FROM decided"
ORACLE["robots_filter"] = f"WITH {DECIDED} SELECT resp_id, url FROM decided WHERE allowed"

# Pacing: 2 requests per day

ORACLE["token_bucket_wait"] = f"""WITH {fixture('request_log')},
numbered AS (SELECT domain, ts, seq, row_number() OVER (PARTITION BY domain ORDER BY ts, seq) - 1 AS n,
  epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY domain) AS us FROM request_log),
level AS (SELECT *, n - 2.0::DOUBLE * (us / 1e6::DOUBLE) / 86400.0::DOUBLE AS s FROM numbered),
lows AS (SELECT *, min(s) OVER (PARTITION BY domain ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS low FROM level)
SELECT domain, seq, CAST(round(greatest(0.0::DOUBLE, (s - low - 1.0::DOUBLE) / 2.0::DOUBLE * 86400.0::DOUBLE) * 1e6::DOUBLE) AS BIGINT) AS wait_us
FROM lows"""

# DNS

DNS = f"""{fixture('dns_targets', 'dns_records')},
txt AS (SELECT domain, owner, rec_no, string_agg(value, '' ORDER BY chunk_no) AS value FROM dns_records WHERE rrtype = 'TXT' GROUP BY ALL),
spf AS (SELECT domain, arg_min(value, rec_no) AS v FROM txt WHERE owner = domain AND starts_with(value, 'v=spf1') GROUP BY domain),
dmarc AS (SELECT domain, arg_min(value, rec_no) AS v FROM txt WHERE owner = '_dmarc.' || domain AND starts_with(value, 'v=DMARC1') GROUP BY domain),
facts AS (SELECT t.scan_id, t.domain, 'dns://' || t.domain AS url, spf.v AS spf, dmarc.v AS dmarc,
  EXISTS (SELECT 1 FROM txt x WHERE x.owner = t.domain) AS apex_txt,
  EXISTS (SELECT 1 FROM txt x WHERE x.owner = '_dmarc.' || t.domain) AS mail_txt,
  EXISTS (SELECT 1 FROM dns_records r WHERE r.domain = t.domain AND r.rrtype = 'CAA') AS caa,
  EXISTS (SELECT 1 FROM dns_records r WHERE r.domain = t.domain AND r.rrtype = 'DNSKEY') AS dnskey
  FROM dns_targets t LEFT JOIN spf USING (domain) LEFT JOIN dmarc USING (domain)),
spf_f AS (
  {found('url', "'medium'", 'dns_misconfiguration', "'Missing SPF record'",
         "CASE WHEN apex_txt THEN 'The domain has TXT records, but none starts with v=spf1' ELSE 'The domain has no TXT records' END")} FROM facts WHERE spf IS NULL
  UNION ALL {found('url', "'medium'", 'dns_misconfiguration', "'Weak SPF policy'", "'The SPF record has neither -all nor ~all'", 'spf')}
    FROM facts WHERE NOT regexp_matches(lower(spf), '[-~]all')
  UNION ALL {found('url', "'low'", 'dns_misconfiguration', "'Soft-fail SPF policy'", "'The SPF record uses ~all instead of -all'", 'spf')}
    FROM facts WHERE lower(spf) LIKE '%~all%' AND lower(spf) NOT LIKE '%-all%'),
dmarc_f AS (
  {found('url', "'high'", 'dns_misconfiguration', "'Missing DMARC record'",
         "CASE WHEN mail_txt THEN 'The _dmarc name has TXT records, but none starts with v=DMARC1' ELSE 'The _dmarc name has no TXT records' END")} FROM facts WHERE dmarc IS NULL
  UNION ALL {found('url', "'medium'", 'dns_misconfiguration', "'DMARC policy is monitor-only'", "'The DMARC policy p=none blocks nothing'", 'dmarc')}
    FROM facts WHERE lower(dmarc) LIKE '%p=none%'
  UNION ALL {found('url', "'low'", 'dns_misconfiguration', "'DMARC policy is quarantine (not reject)'", "'The DMARC policy p=quarantine is weaker than p=reject'", 'dmarc')}
    FROM facts WHERE lower(dmarc) LIKE '%p=quarantine%' AND lower(dmarc) NOT LIKE '%p=none%'),
caa_f AS ({found('url', "'low'", 'dns_misconfiguration', "'Missing CAA record'", "'No CAA record restricts who may issue certificates'")} FROM facts WHERE NOT caa),
dnssec_f AS ({found('url', "'low'", 'dns_misconfiguration', "'DNSSEC not enabled'", "'No DNSKEY record was found'")} FROM facts WHERE NOT dnskey),
dns_findings AS (SELECT * FROM spf_f UNION ALL SELECT * FROM dmarc_f UNION ALL SELECT * FROM caa_f UNION ALL SELECT * FROM dnssec_f)"""
ORACLE["dns_txt"] = f"WITH {DNS} SELECT * FROM txt"
ORACLE["dns_spf"] = f"WITH {DNS} SELECT * FROM spf_f"
ORACLE["dns_dmarc"] = f"WITH {DNS} SELECT * FROM dmarc_f"
ORACLE["dns_caa"] = f"WITH {DNS} SELECT * FROM caa_f"
ORACLE["dns_dnssec"] = f"WITH {DNS} SELECT * FROM dnssec_f"
ORACLE["dns_posture"] = f"WITH {DNS} SELECT * FROM dns_findings"

# TLS


def tls_found(severity: str, title: str, description: str, where: str, evidence: str = "''") -> str:
    return found("url", lit(severity), "tls_issue", lit(title), lit(description), evidence, scan="domain, ") + f" FROM obs WHERE {where}"


# max-age as the first part that is a number: the fixture's nine values, spelled out.
TLS = f"""{fixture('tls_observations')},
obs AS (SELECT *, 'tls://' || domain || ':443' AS url, (not_after_epoch - observed_epoch) // 86400 AS days,
  CASE hsts WHEN 'max-age=31536000; includeSubDomains' THEN 31536000 WHEN 'max-age=100' THEN 100
    WHEN 'includeSubDomains; Max-Age="15551999"' THEN 15551999 WHEN 'max-age=15552000' THEN 15552000
    WHEN 'max-age=abc; max-age=5' THEN 5 END AS age FROM tls_observations),
tls_c AS ({tls_found('medium', 'Port 443 unreachable', 'No TCP connection to port 443', 'NOT tcp_ok')}
  UNION ALL {tls_found('high', 'TLS handshake failed', 'The TLS handshake did not complete', 'tcp_ok AND NOT handshake_ok')}),
tls_v AS ({tls_found('info', 'TLS 1.3 not negotiated', 'The server chose TLS 1.2', "handshake_ok AND protocol = 'TLSv1.2'", "'TLSv1.2'")}
  UNION ALL {tls_found('critical', 'Obsolete TLS version', 'The server chose TLS 1.0 or 1.1', "handshake_ok AND protocol IN ('TLSv1.0', 'TLSv1.1')",
                       "'Some(' || replace(protocol, '.', '_') || ')'")}),
tls_e AS ({tls_found('critical', 'TLS certificate expired', 'The certificate is out of date', 'handshake_ok AND days < 0', "(-days) || ' days past expiry'")}
  UNION ALL {tls_found('high', 'TLS certificate expiring soon', 'The certificate ends within 14 days', 'handshake_ok AND days >= 0 AND days < 14', "days || ' days remaining'")}
  UNION ALL {tls_found('medium', 'TLS certificate expires within 30 days', 'The certificate ends within 30 days', 'handshake_ok AND days >= 14 AND days < 30', "days || ' days remaining'")}),
tls_h AS ({tls_found('medium', 'Missing HSTS header', 'The site does not send Strict-Transport-Security', 'handshake_ok AND http_ok AND hsts IS NULL')}
  UNION ALL {tls_found('low', 'HSTS max-age below 6 months', 'HSTS holds for less than 15552000 seconds', 'handshake_ok AND http_ok AND age < 15552000', 'hsts')}
  UNION ALL {tls_found('info', 'HSTS missing includeSubDomains', 'HSTS does not cover subdomains', "handshake_ok AND http_ok AND hsts NOT ILIKE '%includesubdomains%'", 'hsts')}),
tls_findings AS (SELECT * FROM tls_c UNION ALL SELECT * FROM tls_v UNION ALL SELECT * FROM tls_e UNION ALL SELECT * FROM tls_h)"""
for _name, _part in (("connection", "c"), ("version", "v"), ("expiry", "e"), ("hsts", "h")):
    ORACLE[f"tls_{_name}"] = f"WITH {TLS} SELECT * EXCLUDE (domain) FROM tls_{_part}"
ORACLE["tls_posture"] = f"WITH {TLS} SELECT * EXCLUDE (domain) FROM tls_findings"

# CT

CT = f"""{fixture('ct_entries')},
names AS (SELECT domain, unnest(string_split(name_value, chr(10))) AS raw FROM ct_entries),
subs AS (SELECT DISTINCT domain, lower(regexp_replace(trim(raw), '^(\\*\\.)+', '')) AS sub FROM names),
numbered_subs AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY sub) AS n FROM subs WHERE sub <> '' AND suffix(sub, domain) AND sub <> domain),
ct_findings AS ({found("'https://' || sub", "'info'", 'subdomain_discovered', "'Subdomain found: ' || sub",
                       "'Named in certificate transparency logs; check that it is still in use'", 'sub', scan='n, domain, ')}
  FROM numbered_subs)"""
ORACLE["ct_subdomains"] = f"WITH {CT} SELECT * EXCLUDE (n) FROM ct_findings WHERE n <= 50"
ORACLE["ct_subdomain_names"] = f"WITH {CT} SELECT domain, sub AS evidence FROM numbered_subs"
ORACLE["ct_match_targets"] = f"""WITH {CT}, {fixture('dns_targets')},
feed AS (SELECT DISTINCT sub, regexp_extract(sub, '(?:^|\\.)(d[0-9]+\\.example\\.com)$', 1) AS domain FROM subs)
SELECT f.domain, f.sub AS subdomain FROM feed f JOIN dns_targets t ON t.domain = f.domain WHERE f.sub <> f.domain"""

# Reports

EVERYTHING = f"""{PAGE}, {DNS}, {TLS}, {CT},
everything AS (SELECT {ALL_COLUMNS} FROM page_findings UNION ALL SELECT {ALL_COLUMNS} FROM dns_findings
  UNION ALL SELECT {ALL_COLUMNS} FROM tls_findings JOIN dns_targets USING (domain)
  UNION ALL SELECT {ALL_COLUMNS} FROM ct_findings JOIN dns_targets USING (domain))"""
ORACLE["all_findings"] = f"WITH {EVERYTHING} SELECT * FROM everything"
ORACLE["ranked_findings"] = f"""WITH {EVERYTHING}
SELECT scan_id, url, title, evidence, line_number,
  CAST(list_position(['critical', 'high', 'medium', 'low', 'info'], severity) - 1 AS INT) AS severity_rank,
  CASE severity WHEN 'critical' THEN 'CRIT' WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN ' MED' WHEN 'low' THEN ' LOW' ELSE 'INFO' END AS tag,
  upper(severity) AS severity_label,
  CASE finding_type WHEN 'exposed_secret' THEN 'Exposed Secret' WHEN 'sensitive_file' THEN 'Sensitive File'
    WHEN 'missing_security_header' THEN 'Missing Security Header' WHEN 'information_disclosure' THEN 'Information Disclosure'
    WHEN 'dns_misconfiguration' THEN 'DNS Misconfiguration' WHEN 'tls_issue' THEN 'TLS Issue' ELSE 'Subdomain Discovered' END AS type_label
FROM everything"""
COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in rules.SEVERITIES)
ORACLE["summary"] = f"""WITH {PAGE}, {fixture('dns_targets')},
scans AS (SELECT target AS scan_id FROM responses_flat UNION SELECT scan_id FROM dns_targets),
counts AS (SELECT scan_id, count(*) AS total_findings, {COUNTS} FROM page_findings GROUP BY scan_id)
SELECT scan_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('total_findings', *rules.SEVERITIES))} FROM scans LEFT JOIN counts USING (scan_id)"""
RAW = """to_json({'url': url, 'severity': severity, 'finding_type': finding_type, 'title': title, 'description': description,
    'evidence': evidence, 'line_number': line_number})"""
ROWS = f"SELECT scan_id, severity, finding_type AS type, title, description, url AS location, CAST({RAW} AS VARCHAR) AS raw_data"
ORACLE["finding_rows"] = f"WITH {EVERYTHING} {ROWS} FROM everything"
ORACLE["scan_status"] = f"""WITH {fixture('scan_events')}, last AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY ts DESC, seq DESC) AS n FROM scan_events)
SELECT scan_id, status, CASE WHEN status <> 'running' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS completed_at
FROM last WHERE n = 1"""
ORACLE["scan_reports"] = f"""WITH RECURSIVE {SITE_FINDINGS}, {INFO},
ordered AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY
    list_position(['critical', 'high', 'medium', 'low', 'info'], severity), url, line_number NULLS FIRST, title, evidence, finding_type) - 1 AS n FROM site_findings),
counts AS (SELECT scan_id, count(*) AS total_findings, {COUNTS} FROM site_findings GROUP BY scan_id),
parts AS (SELECT scan_id, CAST(n // 3 AS INT) AS part_no, list({{'url': url, 'severity': severity, 'finding_type': finding_type, 'title': title,
    'description': description, 'evidence': evidence, 'line_number': line_number}} ORDER BY n) AS findings FROM ordered GROUP BY ALL)
SELECT scan_id, coalesce(part_no, 0) AS part_no, CAST(to_json({{
  'scan_info': {{'target': target, 'start_time': start_time, 'end_time': end_time, 'duration_seconds': duration_seconds, 'pages_crawled': pages_crawled,
    'urls_discovered': urls_discovered, 'errors': errors, 'bytes_downloaded': bytes_downloaded}},
  'summary': {{'total_findings': coalesce(total_findings, 0), {', '.join(f"'{s}': coalesce({s}, 0)" for s in rules.SEVERITIES)}}},
  'findings': coalesce(findings, [])}}) AS VARCHAR) AS report
FROM info LEFT JOIN counts USING (scan_id) LEFT JOIN parts USING (scan_id)"""

# Streams: drained, they hold what the batch form returns.

ORACLE["stream_scan"] = ORACLE["scan_page"]
ORACLE["stream_finding_rows"] = f"WITH {PAGE} {ROWS} FROM page_findings"
ORACLE["stream_append_rows"] = ORACLE["stream_finding_rows"]
ORACLE["stream_scan_allowed"] = f"""WITH {PAGE}, {ROBOTS}, {JUDGED},
allowed_findings AS (SELECT * REPLACE (regexp_replace(url, '#.*$', '') || CASE WHEN regexp_matches(url, '^https://[^/]*$') THEN '/' ELSE '' END AS url)
  FROM page_findings WHERE url IN (SELECT url FROM decided WHERE allowed))
{ROWS} FROM allowed_findings"""
ORACLE["stream_dedupe_within"] = f"""WITH {fixture('url_sightings')}
SELECT DISTINCT scan_id, regexp_replace(url, '#.*$', '') AS url FROM url_sightings"""
ORACLE["stream_dedupe"] = f"""WITH {fixture('crawl_edges')}
SELECT DISTINCT 'all' AS scan_id, regexp_replace(dst_url, '#.*$', '') AS url FROM crawl_edges"""
ORACLE["stream_pacing_wait"] = ORACLE["token_bucket_wait"]
ORACLE["stream_summary"] = f"WITH {PAGE} SELECT scan_id, count(*) AS total_findings, {COUNTS} FROM page_findings GROUP BY scan_id"

# Report files hold what the reports do.

ORACLE["scan_report_files"] = ORACLE["site_findings"]
ORACLE["csv_report"] = ORACLE["scan_page"]

# Readers: Parquet keeps all rows, of the lines of JSON some are cut off; rows without a key count for both.


def read_back(name: str, with_tables: str, table: str, columns: str, key: str, cut: str, no_key: str) -> None:
    nothing = ", ".join(f"NULL AS {c.split(' AS ')[-1]}" for c in columns.split(", "))
    ORACLE[name] = f"""WITH {with_tables},
marked AS (SELECT *, coalesce({cut}, false) AS is_cut, coalesce({no_key}, false) AS no_key FROM {table}),
forms AS (SELECT 'parquet' AS fmt, CASE WHEN no_key THEN 'missing {key}' END AS reason, * FROM marked
  UNION ALL SELECT 'json', CASE WHEN is_cut THEN 'unreadable' WHEN no_key THEN 'missing {key}' END, * FROM marked)
SELECT {columns}, fmt, CAST(NULL AS VARCHAR) AS reason, CAST(1 AS BIGINT) AS n FROM forms WHERE reason IS NULL
UNION ALL SELECT {nothing}, fmt, reason, count(*) FROM forms WHERE reason IS NOT NULL GROUP BY fmt, reason"""


_HEADER_COUNT = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ("h_content_type", "h_server", *HEADER_COLUMNS))
read_back("read_responses", f"""{FLAT}, answers AS (SELECT target AS scan_id, url, status, {_HEADER_COUNT} AS headers,
  CAST(strlen(body) AS INT) AS bytes, content_length, fetch_error FROM responses_flat)""", "answers",
          "scan_id, url, status, headers, bytes, content_length, fetch_error", "url", "status = 404", "url LIKE '%/.npmrc'")
read_back("read_robots", fixture("robots_files"), "robots_files", "origin, status, content", "origin", "status IS NULL", "status = 404")
read_back("read_dns", fixture("dns_records"), "dns_records", "domain, owner, rrtype, rec_no, chunk_no, value", "rrtype", "rrtype = 'CAA'", "rrtype = 'DNSKEY'")
read_back("read_tls", fixture("tls_observations"), "tls_observations",
          "domain, tcp_ok, handshake_ok, protocol, not_after_epoch, observed_epoch, http_ok, hsts", "domain", "NOT http_ok", "protocol = 'TLSv1.0'")
read_back("read_ct", fixture("ct_entries"), "ct_entries", "domain, name_value", "name_value", "name_value LIKE ' %'", "name_value = 'www.unrelated.example.org'")
