"""Rule lists the scan operators evaluate.

Each list is an argument of the operator that uses it, so a caller can extend or
replace it.  Titles, severities, patterns, paths and header names are fixed values:
results only agree with other scanners of this family when they are spelled exactly so.
"""

from __future__ import annotations

from typing import NamedTuple

# Severity names, most severe first, and their display forms.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_LABELS = {
    "critical": "CRITICAL",
    "high": "HIGH",
    "medium": "MEDIUM",
    "low": "LOW",
    "info": "INFO",
}
SEVERITY_TAGS = {"critical": "CRIT", "high": "HIGH", "medium": " MED", "low": " LOW", "info": "INFO"}

# Finding types and their display forms.
FINDING_TYPE_LABELS = {
    "exposed_secret": "Exposed Secret",
    "sensitive_file": "Sensitive File",
    "missing_security_header": "Missing Security Header",
    "information_disclosure": "Information Disclosure",
    "dns_misconfiguration": "DNS Misconfiguration",
    "tls_issue": "TLS Issue",
    "subdomain_discovered": "Subdomain Discovered",
}

# Limits and defaults.
MAX_RESPONSE_BYTES = 10 * 1024 * 1024
MAX_SUBDOMAINS = 50
DEFAULT_DEPTH = 3
DEFAULT_RATE = 10.0
HSTS_MIN_AGE = 15_552_000
EXPIRY_HIGH_DAYS = 14
EXPIRY_MEDIUM_DAYS = 30
HEADER_ABSENT = "Header not present"
ROBOTS_BLOCKED = "Blocked by robots.txt"
SKIPPED_HREF_PREFIXES = ("javascript:", "mailto:", "tel:", "#", "data:")


class Detector(NamedTuple):
    """A secret detector.

    ``anchors``: literals of which at least one occurs in every match, looked up with a byte
    search before the regex runs.  ``fold``: look them up in the lower-cased text.
    ``group``: the regex group that holds the secret.
    """

    title: str
    severity: str
    pattern: str
    anchors: tuple[str, ...]
    description: str
    group: int = 0
    fold: bool = False


# Detector titles, severities and patterns, in registry order.
# Java's \s, \w and (?i) are ASCII by default.  (?U:..) makes the classes Unicode, and the
# letters that have a non-ASCII case partner (s: U+017F, k: U+212A) spell it out.
# (?d) lets '.' stop at a line feed only.  Two patterns look for the first possible start
# once per line or word, (?>..), as a search from every start is quadratic on hostile text.
DETECTORS = (
    Detector(
        "AWS Access Key", "critical",
        r"AKIA[0-9A-Z]{16}",
        ("AKIA",),
        "The page contains an AWS access key ID",
    ),
    Detector(
        "AWS Secret Key", "critical",
        r"aws_secret_access_key(?U:\s*)=(?U:\s*)[A-Za-z0-9/+=]{40}",
        ("aws_secret_access_key",),
        "The page contains an AWS secret access key",
    ),
    Detector(
        "GitHub Personal Access Token", "critical",
        r"ghp_[a-zA-Z0-9]{36,40}",
        ("ghp_",),
        "The page contains a GitHub personal access token",
    ),
    Detector(
        "Private Key", "critical",
        r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----",
        ("PRIVATE KEY-----",),
        "The page contains the header of a PEM private key",
    ),
    Detector(
        "Stripe API Key", "critical",
        r"[sr]k_(live|test)_[0-9a-zA-Z]{24,}",
        ("k_live_", "k_test_"),
        "The page contains a Stripe key",
    ),
    Detector(
        "SendGrid API Key", "critical",
        r"SG\.[0-9A-Za-z\-_]{22}\.[0-9A-Za-z\-_]{43}",
        ("SG.",),
        "The page contains a SendGrid key",
    ),
    Detector(
        "Google API Key", "high",
        r"AIza[0-9A-Za-z\-_]{35}",
        ("AIza",),
        "The page contains a Google API key",
    ),
    Detector(
        "Slack Token", "high",
        r"xox[baprs]-[0-9a-zA-Z\-]{10,48}",
        ("xox",),
        "The page contains a Slack token",
    ),
    Detector(
        "Slack Webhook URL", "high",
        r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[a-zA-Z0-9]{24}",
        ("hooks.slack.com/services/T",),
        "The page contains the URL of a Slack incoming webhook",
    ),
    Detector(
        "Mailgun API Key", "high",
        r"key-[0-9a-zA-Z]{32}",
        ("key-",),
        "The page contains a Mailgun key",
    ),
    Detector(
        "Twilio API Key", "high",
        r"SK[0-9a-fA-F]{32}",
        ("SK",),
        "The page contains a Twilio key",
    ),
    Detector(
        "Heroku API Key", "high",
        r"(?idm)^(?>.*?(?=hero[k\x{212a}]u))"
        r"(hero[k\x{212a}]u.*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})",
        ("heroku",),
        "The page contains a Heroku key",
        group=1,
        fold=True,
    ),
    Detector(
        "Database Connection String", "critical",
        r"(?i)(po[s\x{17f}]tgre[s\x{17f}]|my[s\x{17f}]ql|mongodb|redi[s\x{17f}]|amqp)(\+(?U:\w+))?://(?U:[^\s<>\"']{10,})",
        ("://",),
        "The page contains a database URL that may carry credentials",
    ),
    Detector(
        "JWT Token", "medium",
        r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))"
        r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
        ("eyJ",),
        "The page contains a JSON Web Token",
        group=1,
    ),
    Detector(
        "Hardcoded Secret", "high",
        # The lookahead rejects most starts before the alternation is tried.
        r"(?=[pPsSaA\x{17f}])(?i)"
        r"(pa[s\x{17f}][s\x{17f}]word|pa[s\x{17f}][s\x{17f}]wd|[s\x{17f}]ecret|api_[k\x{212a}]ey|api[k\x{212a}]ey|acce[s\x{17f}][s\x{17f}]_[k\x{212a}]ey"
        r"|auth_to[k\x{212a}]en|private_[k\x{212a}]ey)"
        r"(?U:\s*)[=:](?U:\s*)['\"][A-Za-z0-9/+=@\-_.!#$%\x{17f}\x{212a}]{8,}['\"]",
        # Lower-casing leaves U+017F alone, so a text that has it is always searched.
        ("password", "passwd", "secret", "api_key", "apikey", "access_key", "auth_token",
         "private_key", "ſ"),
        "The page assigns a quoted literal to a credential name",
        fold=True,
    ),
)


class PathRule(NamedTuple):
    path: str
    severity: str
    description: str


# Probed paths and severities; info paths are probed but never reported.
SENSITIVE_PATHS = (
    PathRule("/.env", "critical", "An environment file is readable"),
    PathRule("/.git/config", "critical", "The Git configuration is readable"),
    PathRule("/.git/HEAD", "critical", "The Git HEAD reference is readable"),
    PathRule("/.htpasswd", "critical", "An Apache password file is readable"),
    PathRule("/wp-config.php", "critical", "The WordPress configuration is readable"),
    PathRule("/.aws/credentials", "critical", "An AWS credentials file is readable"),
    PathRule("/backup.sql", "critical", "A database backup is readable"),
    PathRule("/dump.sql", "critical", "A database dump is readable"),
    PathRule("/.npmrc", "high", "An npm configuration, which may hold tokens, is readable"),
    PathRule("/.dockerenv", "medium", "A Docker environment marker is readable"),
    PathRule("/docker-compose.yml", "medium", "A Compose file, which may hold secrets, is readable"),
    PathRule("/.htaccess", "medium", "The Apache access configuration is readable"),
    PathRule("/phpinfo.php", "medium", "A PHP information page shows the server setup"),
    PathRule("/server-status", "medium", "The Apache status page is readable"),
    PathRule("/elmah.axd", "medium", "The ELMAH error log is readable"),
    PathRule("/.DS_Store", "low", "macOS folder metadata is readable"),
    PathRule("/crossdomain.xml", "low", "A Flash cross-domain policy is served"),
    PathRule("/robots.txt", "info", "A robots file is served"),
    PathRule("/sitemap.xml", "info", "A sitemap is served"),
    PathRule("/.well-known/security.txt", "info", "Security contact data is served"),
)


class HeaderRule(NamedTuple):
    key: str
    name: str
    severity: str


# Security headers expected on HTML responses.
SECURITY_HEADERS = (
    HeaderRule("content-security-policy", "Content-Security-Policy", "medium"),
    HeaderRule("x-frame-options", "X-Frame-Options", "medium"),
    HeaderRule("x-content-type-options", "X-Content-Type-Options", "low"),
    HeaderRule("strict-transport-security", "Strict-Transport-Security", "medium"),
    HeaderRule("x-xss-protection", "X-XSS-Protection", "low"),
    HeaderRule("referrer-policy", "Referrer-Policy", "low"),
    HeaderRule("permissions-policy", "Permissions-Policy", "low"),
)
