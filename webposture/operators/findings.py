"""The one output record, as struct column and as table."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture import rules

FIELDS = ("url", "severity", "finding_type", "title", "description", "evidence", "line_number")


def _text(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(
    url: Column,
    severity: str | Column,
    finding_type: str,
    title: str | Column,
    description: str | Column,
    evidence: str | Column = "",
    line_number: Column | None = None,
) -> Column:
    """A finding as a struct column."""
    line = F.lit(None) if line_number is None else line_number
    return F.struct(
        url.alias("url"),
        _text(severity).alias("severity"),
        F.lit(finding_type).alias("finding_type"),
        _text(title).alias("title"),
        _text(description).alias("description"),
        _text(evidence).alias("evidence"),
        line.cast("int").alias("line_number"),
    )


def present(*candidates: Column) -> Column:
    """The candidates that are not NULL, as an array."""
    return F.array_compact(F.array(*candidates))


def emit(df: DataFrame, findings: Column) -> DataFrame:
    """One output row per element of the ``findings`` array."""
    keep = [F.col("scan_id")] if "scan_id" in df.columns else []
    exploded = df.select(*keep, F.explode(findings).alias("f"))
    return exploded.select(*keep, *[F.col("f")[name].alias(name) for name in FIELDS])


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    literals = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return literals[key]


def severity_rank(severity: Column) -> Column:
    """0 for critical up to 4 for info."""
    return lookup(severity, {name: rank for rank, name in enumerate(rules.SEVERITIES)}).cast("int")


def severity_label(severity: Column) -> Column:
    return lookup(severity, rules.SEVERITY_LABELS)


def severity_tag(severity: Column) -> Column:
    return lookup(severity, rules.SEVERITY_TAGS)


def finding_type_label(finding_type: Column) -> Column:
    return lookup(finding_type, rules.FINDING_TYPE_LABELS)
