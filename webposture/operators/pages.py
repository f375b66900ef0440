"""Checks on fetched pages: leaked secrets, sensitive files, security headers, server version.

All are expressions on one row of ``responses``, so they run without shuffle and unchanged on a
stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture import rules
from webposture.functions import headers as H
from webposture.functions import urls as U
from webposture.functions.text import any_of, redact, split_lines
from webposture.operators.findings import present


def _too_large(max_bytes: int | None) -> Column:
    over = F.col("content_length") > max_bytes if max_bytes is not None else F.lit(False)
    return F.coalesce(over, F.lit(False))


def fetched(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Responses that a crawler would have read: without fetch error and within the limit, if there is one."""
    return responses.filter(F.col("fetch_error").isNull() & ~_too_large(max_bytes))


def size_gate(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Mark failed fetches, and responses whose declared length is over the limit, as errors without content.

    Adds ``error`` and ``bytes`` (size of the body, 0 on errors) and empties headers and body of
    failed fetches.  Responses without declared length pass.
    """
    too_large = _too_large(max_bytes)
    error = F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error")).when(
        too_large, F.concat(F.lit("Response too large: "), F.col("content_length").cast("string"), F.lit(" bytes"))
    )
    read = F.col("fetch_error").isNull() & ~too_large
    return responses.withColumns({
        "error": error,
        "bytes": F.when(read, F.coalesce(F.octet_length("body"), F.lit(0))).otherwise(0).cast("bigint"),
        "body": F.when(read, F.col("body")),
        "headers": F.when(read, F.col("headers")),
    })


def page_lines(responses: DataFrame) -> DataFrame:
    """One row per line of a body, numbered from 1; an empty last line is no line."""
    split = responses.select("scan_id", "url", split_lines(F.col("body")).alias("lines"))
    lines = split.select("scan_id", "url", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    return lines.filter((F.col("line") != "") | (F.col("pos") < F.col("n") - 1)).select(
        "scan_id", "url", (F.col("pos") + 1).cast("int").alias("line_number"), "line"
    )


def _may_match(text: Column, folded: Column, detector: rules.Detector) -> Column:
    """A byte search for the anchors: cheap, and spares most texts the decoding a regex needs."""
    searched = folded if detector.fold else text
    return any_of([F.contains(searched, F.lit(a)) for a in detector.anchors])


def _looked_up(responses: DataFrame, paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS) -> DataFrame:
    """Add what several rules look at, so that it is made once per row and not once per rule."""
    headers, url, path = F.col("headers"), F.col("url"), F.col("__path")
    # The path's end decides; a text that is no URL is searched as a whole.
    hits = [F.coalesce(F.endswith(path, F.lit(r.path)), F.contains(url, F.lit(r.path))) for r in paths]
    return fetched(responses).withColumns({
        "__path": U.path_of(url),
        "__names": H.header_names(headers),
        "__html": H.is_html(headers),
        "__server": H.readable_value(headers, "server"),
    }).withColumn("__rule", F.coalesce(*[F.when(hit, F.lit(i)) for i, hit in enumerate(hits)], F.lit(None)))


#: Severity, type, title, description and evidence that a rule's number stands for; evidence NULL where the page gives it.
Texts = list[tuple[str, str, str, str, str | None]]


def _texts(
    detectors: Sequence[rules.Detector] = (), paths: Sequence[rules.PathRule] = (), expected: Sequence[rules.HeaderRule] = ()
) -> Texts:
    """All rules in the order of their numbers: detectors, paths, headers, and the Server header as the last one."""
    return [
        *[(d.severity, "exposed_secret", d.title, d.description, None) for d in detectors],
        *[(p.severity, "sensitive_file", f"Sensitive file accessible: {p.path}", p.description, f"HTTP 200 returned for {p.path}") for p in paths],
        *[(h.severity, "missing_security_header", f"Missing {h.name} header", f"The response does not set {h.name}", rules.HEADER_ABSENT) for h in expected],
        ("low", "information_disclosure", "Server version disclosure", "The Server header tells the software and its version", None),
    ]


def _hit(rule: Column, evidence: Column | None = None, line_number: Column | None = None) -> Column:
    """A finding without the texts of its rule."""
    return F.struct(
        rule.cast("int").alias("rule"),
        (F.lit(None) if evidence is None else evidence).cast("string").alias("evidence"),
        (F.lit(None) if line_number is None else line_number).cast("int").alias("line_number"),
    )


def described(hits: DataFrame, texts: Texts) -> DataFrame:
    """The findings that rows of ``hits`` stand for."""
    hit = F.col("hit")
    keep = [c for c in ("scan_id", "url") if c in hits.columns]

    def of_rule(field: int) -> Column:
        return F.get(F.array(*[F.lit(text[field]).cast("string") for text in texts]), hit["rule"])

    return hits.select(*keep, F.explode("hits").alias("hit")).select(
        *keep,
        of_rule(0).alias("severity"), of_rule(1).alias("finding_type"), of_rule(2).alias("title"), of_rule(3).alias("description"),
        F.coalesce(hit["evidence"], of_rule(4)).alias("evidence"),
        hit["line_number"].alias("line_number"),
    )


def sensitive_file_hits(paths: Sequence[rules.PathRule], first: int) -> Column:
    """At most one: status 200 and the first listed path the URL's path ends with."""
    rule = F.col("__rule")
    severity = F.get(F.array(*[F.lit(p.severity) for p in paths]), rule)
    return F.when((F.col("status") == 200) & rule.isNotNull() & (severity != "info"), F.array(_hit(rule + first)))


def missing_header_hits(expected: Sequence[rules.HeaderRule], first: int) -> Column:
    """One for each expected header that a successful HTML response lacks."""
    names = F.col("__names")
    missing = present(*[F.when(~F.array_contains(names, rule.key), _hit(F.lit(first + i))) for i, rule in enumerate(expected)])
    return F.when((F.col("status") == 200) & F.col("__html"), missing)


def server_hits(number: int) -> Column:
    """The Server header tells a version, on any status."""
    server = F.col("__server")
    return F.when(F.contains(server, F.lit("/")), F.array(_hit(F.lit(number), server)))


def scan_content(responses: DataFrame, detectors: Sequence[rules.Detector] = rules.DETECTORS) -> DataFrame:
    """Leaked secrets on every status and content type: the first match per line and detector."""
    return described(secret_hits(responses, detectors), _texts(detectors))


def secret_hits(responses: DataFrame, detectors: Sequence[rules.Detector]) -> DataFrame:
    """The leaked secrets as (scan_id, url, hits).

    Clean pages are dropped before their lines are split, clean lines before the matches are cut
    out, and only the redacted match leaves the last projection.
    """
    body, line, folded = F.col("body"), F.col("line"), F.col("folded")
    suspect = any_of([_may_match(body, folded, d) & body.rlike(d.pattern) for d in detectors])
    # Gated inside the generator: as a filter the test would be pushed below the projection that
    # makes the body, and the body made again for every detector.
    split_suspect = F.when(suspect, F.split(body, "\n", -1))
    pages = fetched(responses).select("scan_id", "url", "body", F.lower(body).alias("folded"))
    lines = pages.select("scan_id", "url", F.posexplode(split_suspect).alias("pos", "line"))
    matches = F.array(*[
        F.when(
            _may_match(line, folded, d),
            F.struct(F.lit(i).alias("detector"), F.regexp_extract(line, d.pattern, d.group).alias("secret")),
        )
        for i, d in enumerate(detectors)
    ])
    lines = lines.select("scan_id", "url", "pos", "line", F.lower(line).alias("folded"))
    matches = F.when(any_of([_may_match(line, folded, d) for d in detectors]), matches)
    hits = lines.select("scan_id", "url", "pos", F.explode(matches).alias("m")).filter(F.col("m.secret") != "")

    return hits.select(
        "scan_id", "url", F.array(_hit(F.col("m.detector"), redact(F.col("m.secret")), F.col("pos") + 1)).alias("hits")
    )


def _hits_of(responses: DataFrame, hits: Column, paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS) -> DataFrame:
    """One row for each response that has any; the checks need no body."""
    looked_up = _looked_up(responses, paths)
    keep = [c for c in ("scan_id", "url") if c in looked_up.columns]
    # Not filtered afterwards: the checks would be copied into the filter, too.
    return looked_up.select(*keep, F.explode(F.filter(F.array(hits), lambda found: F.size(found) > 0)).alias("hits"))


def sensitive_files(responses: DataFrame, paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS) -> DataFrame:
    return described(_hits_of(responses, sensitive_file_hits(paths, 0), paths), _texts(paths=paths))


def missing_headers(responses: DataFrame, expected: Sequence[rules.HeaderRule] = rules.SECURITY_HEADERS) -> DataFrame:
    return described(_hits_of(responses, missing_header_hits(expected, 0)), _texts(expected=expected))


def server_disclosure(responses: DataFrame) -> DataFrame:
    return described(_hits_of(responses, server_hits(0)), _texts())


def page_hits(
    responses: DataFrame,
    detectors: Sequence[rules.Detector] = rules.DETECTORS,
    paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS,
    expected: Sequence[rules.HeaderRule] = rules.SECURITY_HEADERS,
    max_bytes: int | None = None,
) -> tuple[DataFrame, Texts]:
    """All page checks on the responses that were fetched: (scan_id, url, hits), and the texts that make them findings.

    Some 50 bytes a finding, for a shuffle: with their texts, findings have 300.  Bodies are read once; the second branch reads only
    the narrow columns.
    """
    responses = fetched(responses, max_bytes)
    paths_from, headers_from = len(detectors), len(detectors) + len(paths)
    checks = (
        sensitive_file_hits(paths, paths_from), missing_header_hits(expected, headers_from), server_hits(headers_from + len(expected)),
    )
    others = F.concat(*[F.coalesce(c, F.array()) for c in checks])
    found = secret_hits(responses, detectors).unionByName(_hits_of(responses, others, paths))
    return found, _texts(detectors, paths, expected)


def scan_page(
    responses: DataFrame,
    detectors: Sequence[rules.Detector] = rules.DETECTORS,
    paths: Sequence[rules.PathRule] = rules.SENSITIVE_PATHS,
    expected: Sequence[rules.HeaderRule] = rules.SECURITY_HEADERS,
    max_bytes: int | None = None,
) -> DataFrame:
    """The findings of all page checks on the responses that were fetched."""
    return described(*page_hits(responses, detectors, paths, expected, max_bytes))
