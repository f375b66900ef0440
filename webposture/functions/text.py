"""Column helpers for text: trimming, redaction, line handling."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions) if conditions else F.lit(False)


def keep_where(df: DataFrame, condition: Column, column: str) -> DataFrame:
    """The rows that meet ``condition``, which tests the costly ``column``.

    An ordinary filter is pushed below the projections that make the column, and their
    expressions copied into every use.  As output of a generator the column shields them, from
    this filter and from later ones.
    """
    kept = F.when(condition, F.array(F.col(column)))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(kept).alias(column))


def trim_space(text: Column) -> Column:
    """Strip all Unicode white space; Spark's ``trim`` strips U+0020 only."""
    # The lookbehind lets a run be tried from its start only; from every position it is quadratic.
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++\z", "")


def split_lines(text: Column) -> Column:
    r"""Lines ended by ``\n`` or ``\r\n``; a lone ``\r`` does not end a line."""
    return F.split(text, r"\r?\n", -1)


def redact(secret: Column) -> Column:
    """Hide a secret: all stars up to 8 bytes, otherwise its first and last 4 bytes.

    Where the 4-byte cut falls inside a character, 4 characters are shown instead.
    """
    raw = secret.cast("binary")
    head = F.substring(raw, 1, 4).cast("string")
    tail = F.substring(raw, -4, 4).cast("string")
    shown = F.concat(
        F.when(F.is_valid_utf8(head), head).otherwise(F.left(secret, F.lit(4))),
        F.lit("..."),
        F.when(F.is_valid_utf8(tail), tail).otherwise(F.right(secret, F.lit(4))),
    )
    size = F.octet_length(secret)
    return F.when(size <= 8, F.repeat(F.lit("*"), size)).otherwise(shown)
