"""Column helpers for header lists (``array<struct<name,value>>``, order and repeats kept)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_names(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(h["name"]))


def first_value(headers: Column, name: str) -> Column:
    """First value of a header, NULL if absent."""
    named = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.try_element_at(named, F.lit(1))["value"]


def readable_value(headers: Column, name: str) -> Column:
    """``first_value`` if it is visible ASCII, else NULL."""
    value = first_value(headers, name)
    return F.when(value.rlike(r"^[\x20-\x7e\t]*\z"), value)


def is_html(headers: Column) -> Column:
    """Content type names ``text/html``; the test is case-sensitive."""
    return F.coalesce(F.contains(readable_value(headers, "content-type"), F.lit("text/html")), F.lit(False))
