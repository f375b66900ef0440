"""Column helpers for http(s) URLs.

``parse_url`` is not used: it keeps the host's case, returns '' for an empty path and
rejects characters that browsers accept and escape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.functions.hosts import canonical_host_of
from webposture.functions.text import keep_where

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_WEB = r"(?s)^(?i:https?):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?(#.*)?\z"

# Characters that are percent-encoded per URL component.
_UNSAFE_PATH = r"\x00-\x20\x7f-\x{10ffff}\"<>`{}"
_UNSAFE_QUERY = r"\x00-\x20\x7f-\x{10ffff}\"#<>'"
_UNSAFE_FRAGMENT = r"\x00-\x20\x7f-\x{10ffff}\"<>`"
_FORBIDDEN_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]"

_DOT = r"(?i)^(\.|%2e)\z"
_DOT_DOT = r"(?i)^(\.|%2e){2}\z"
_HAS_DOTS = r"(?i)/(\.|%2e){1,2}(/|\z)"


# URLs that are in normal form as they stand: lower-case scheme, ASCII host that ends in no number, neither user nor port,
# a path without dot segments, and no character that would be encoded.
_NAME = r"(?:[a-z0-9_\-]*+\.)*+[a-z][a-z0-9_\-]*+"
_NORMAL_HOST = rf"^{_NAME}\z"
_NORMAL = (
    rf"^https?://{_NAME}"
    r"(?:/(?!(?:\.|%2[eE]){1,2}(?:[/?#]|\z))[!$-.0-;=@-\[\]-_a-z|~]*+)++"
    r"(?:\?[!$-&(-;=?-~]*+)?+(?:#[!#-;=?-_a-~]*+)?+\z"
)


def strip_fragment(url: Column) -> Column:
    """The key URLs are deduplicated by: everything but the fragment is significant."""
    return F.substring_index(url, "#", 1)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def host_of(url: Column) -> Column:
    """Host of a normalised URL, '' if it has none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)", 1)


def same_host(one: Column, other: Column) -> Column:
    """Whether two normalised URLs have one host.  Equal texts before the path settle it for most, without a pattern."""
    return (F.substring_index(one, "/", 3) == F.substring_index(other, "/", 3)) | (host_of(one) == host_of(other))


def path_of(url: Column) -> Column:
    """Path of a URL without query and fragment, '/' if empty, NULL if the text is no URL."""
    path = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    parsable = url.rlike(r"^(?i:https?)://[^/?#\s]") | url.rlike(r"^(?!(?i:https?):)[A-Za-z][A-Za-z0-9+.\-]*:")
    return F.when(parsable, F.when(path == "", F.lit("/")).otherwise(path))


def origin_of(url: Column) -> Column:
    """``scheme://host`` without port: all ports of a host share one robots file."""
    return F.concat(scheme_of(url), F.lit("://"), host_of(url))


def with_scheme(url: Column) -> Column:
    """Add ``https://`` unless the text starts with ``http://`` or ``https://`` (case-sensitive)."""
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(
        F.concat(F.lit("https://"), url)
    )


def percent_encode(text: Column, unsafe: str) -> Column:
    """Replace every character of the class ``unsafe`` by its UTF-8 bytes as %XX."""
    runs = F.regexp_extract_all(text, F.lit(f"[{unsafe}]+|[^{unsafe}]+"), F.lit(0))
    encoded = F.array_join(
        F.transform(
            runs,
            lambda run: F.when(
                run.rlike(f"^[{unsafe}]"), F.regexp_replace(F.hex(run), "(..)", r"%$1")
            ).otherwise(run),
        ),
        "",
    )
    return F.when(text.rlike(f"[{unsafe}]"), encoded).otherwise(text)


def remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def push(stack: Column, segment: Column) -> Column:
        return (
            F.when(segment.rlike(_DOT_DOT), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when(segment.rlike(_DOT), stack)
            .otherwise(F.concat(stack, F.array(segment)))
        )

    segments = F.split(F.substr(path, F.lit(2)), "/", -1)
    kept = F.aggregate(segments, F.array().cast("array<string>"), push)
    folder = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(_HAS_DOTS), F.concat(F.lit("/"), F.array_join(folder, "/"))).otherwise(path)


def clean(url: Column) -> Column:
    """Drop what URL parsers ignore: control characters and spaces around, tabs and line ends within."""
    cleaned = F.regexp_replace(url, r"^[\x00-\x20]++|(?<![\x00-\x20])[\x00-\x20]++\z|[\t\n\r]++", "")
    return F.when(url.rlike(r"[\x00-\x20]"), cleaned).otherwise(url)


def with_url_parts(df: DataFrame, column: str, out: str = "parts") -> DataFrame:
    """Parse and normalise the http(s) URLs of ``column``.

    Adds ``out``: struct(url, scheme, host, port, path, query, fragment), NULL for text that
    is no valid http(s) URL.  Scheme and host are lower-cased, hosts of other scripts and numeric ones take
    the form of ``functions.hosts``, a default port is dropped, an empty path becomes '/', dot segments are
    resolved, unsafe characters percent-encoded.
    """
    c = {name: f"__{out}_{name}" for name in ("text", "web", "scheme", "authority", "host", "port", "path", "query", "frag")}
    text = F.col(c["text"])
    authority = F.col(c["authority"])
    host_port = F.substring_index(authority, "@", -1)
    has_port = F.contains(host_port, F.lit(":"))
    raw_host = F.when(has_port, F.regexp_extract(host_port, r"(?s)^(\[[^\]]*\]|.*?)(?::[^:\]]*)?\z", 1)).otherwise(host_port)
    decoded = F.when(
        F.contains(raw_host, F.lit("%")), F.try_url_decode(F.replace(raw_host, F.lit("+"), F.lit("%2B")))
    ).otherwise(raw_host)
    raw_port = F.when(has_port, F.regexp_extract(host_port, r"(?s)^(?:\[[^\]]*\]|.*?):([^:\]]*)\z", 1)).otherwise("")

    df = df.withColumn(c["text"], clean(F.col(column)))
    # One pass of the pattern: a cleaned text has no line ends of its own.
    df = df.withColumn(c["web"], F.split(F.regexp_replace(text, _WEB, "$1\n$2\n$3\n$4"), "\n", -1))
    part = lambda i: F.get(F.col(c["web"]), F.lit(i))
    path = F.translate(part(1), "\\", "/")
    df = df.withColumns({
        c["scheme"]: F.when(text.rlike(r"^(?i:https?):"), F.lower(F.substring_index(text, ":", 1))),
        c["authority"]: part(0),
        c["path"]: F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
        c["query"]: percent_encode(part(2), _UNSAFE_QUERY),
        c["frag"]: percent_encode(part(3), _UNSAFE_FRAGMENT),
    })
    df = df.withColumns({
        c["host"]: decoded,
        c["port"]: raw_port,
        c["path"]: remove_dot_segments(F.col(c["path"])),
    })
    plain = F.col(c["host"]).rlike(_NORMAL_HOST)
    df = df.withColumns({
        c["host"]: F.when(plain, F.col(c["host"])).otherwise(canonical_host_of(c["host"])),
        c["path"]: percent_encode(F.col(c["path"]), _UNSAFE_PATH),
    })
    scheme, host, port = F.col(c["scheme"]), F.col(c["host"]), F.col(c["port"])
    number = F.when(port.rlike(r"^[0-9]+\z"), port.try_cast("int"))
    default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
    valid = (
        scheme.isNotNull()
        & (host != "")
        & (host.rlike(r"^\[[0-9a-f:.]+\]\z") | ~host.rlike(_FORBIDDEN_HOST))
        & ((port == "") | (number <= 65535))
    )
    kept_port = F.when(number != default, number)
    user = F.when(F.contains(authority, F.lit("@")), F.regexp_extract(authority, r"(?s)^(.*@)", 1)).otherwise("")
    url = F.concat(
        scheme, F.lit("://"), F.when(user.isin("@", ":@"), F.lit("")).otherwise(user), host,
        F.coalesce(F.concat(F.lit(":"), kept_port.cast("string")), F.lit("")),
        F.col(c["path"]),
        F.col(c["query"]),
        F.col(c["frag"]),
    )
    parts = F.struct(
        url.alias("url"),
        scheme.alias("scheme"),
        host.alias("host"),
        kept_port.alias("port"),
        F.col(c["path"]).alias("path"),
        F.when(F.col(c["query"]) != "", F.substr(F.col(c["query"]), F.lit(2))).alias("query"),
        F.when(F.col(c["frag"]) != "", F.substr(F.col(c["frag"]), F.lit(2))).alias("fragment"),
    )
    return df.withColumn(out, F.when(valid, parts)).drop(*c.values())


def normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """The rows whose ``column`` is a valid http(s) URL, with the normalised URL as ``out``.

    Most URLs are in normal form already, which one pattern tells; only the others are taken apart.
    """
    url = F.col(column)
    df = df.withColumn("__odd", F.when(~url.rlike(_NORMAL), url))
    parsed = with_url_parts(df, "__odd", "__parts").withColumn(
        out, F.when(F.col("__odd").isNull(), F.col(column)).otherwise(F.col("__parts.url"))
    )
    return keep_where(parsed.drop("__parts", "__odd"), F.col(out).isNotNull(), out)


def join_url(base: Column, href: Column, cleaned: bool = False) -> Column:
    """Place ``href`` on top of the normalised http(s) URL ``base``; normalise the result afterwards.

    NULL for schemes other than http and https.  A column that went through ``clean`` already is used as it is: cleaned
    here, it is cleaned anew at each of its uses.
    """
    ref = href if cleaned else clean(href)
    base_scheme = scheme_of(base)
    # "https:page" on an https page is a relative reference.
    same_scheme = F.regexp_extract(ref, r"(?s)^(?i:https?):(?![/\\])(.*)\z", 1)
    relative_form = (scheme_of(ref) == base_scheme) & ref.rlike(r"^[^:]*:(?![/\\])")
    rest = F.when(relative_form, same_scheme).otherwise(ref)
    site = F.regexp_extract(base, r"^https?://[^/?#]*", 0)
    page = F.regexp_extract(base, r"(?s)^[^?#]*", 0)
    folder = F.regexp_extract(base, r"(?s)^https?://[^/?#]*(?:[^?#]*/)?", 0)
    # A base without a path stands for the root.
    folder = F.when(folder == site, F.concat(site, F.lit("/"))).otherwise(folder)
    # The folder above, of a base without dot segments; above the root is the root.
    above = F.regexp_replace(folder, r"(?s)^(https?://[^/]*/(?:.*/)?)[^/]*/\z", "$1")
    # The frequent forms first, which take few patterns.
    return (
        F.when(ref.startswith("//"), F.concat(base_scheme, F.lit(":"), ref))
        .when(ref.startswith("/") & ~ref.startswith("/\\"), F.concat(site, ref))
        .when(ref.startswith("https://") | ref.startswith("http://"), ref)
        .when(ref.startswith("../") & base.rlike(_NORMAL), F.concat(above, F.substr(ref, F.lit(4))))
        .when(ref.startswith("."), F.concat(folder, ref))
        .when(~relative_form & ref.rlike(r"^(?i:https?):"), ref)
        .when(~relative_form & ref.rlike(_SCHEME), F.lit(None))
        .when(rest.rlike(r"^[/\\]{2}"), F.concat(base_scheme, F.lit(":"), rest))
        .when(rest.rlike(r"^[/\\]"), F.concat(site, rest))
        .when(rest.startswith("?"), F.concat(page, rest))
        .when((rest == "") | rest.startswith("#"), F.concat(strip_fragment(base), rest))
        .otherwise(F.concat(folder, rest))
    )
