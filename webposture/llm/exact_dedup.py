"""Exact duplicates by counting quotient filters, confirmed on the texts' bytes.

Every partition of fingerprints becomes a counting quotient filter, cut into segments of its quotient
range.  Segments of the same range merge without loss: their remainders are sorted, so equal
fingerprints meet and their counts add up.  Only texts whose fingerprint has a count above one are
compared byte by byte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.llm.tables import small
from webposture.llm.text import counted
from webposture.session import materialize

#: Quotients in a segment; with as many fingerprints a segment takes about half a megabyte.
SEGMENT_BITS = 14

PIECE = "segment long, low_bits int, occupied binary, run_ends binary, counters binary, slots binary"


def normalized(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def encode(keys: np.ndarray, counts: np.ndarray, low_bits: int) -> dict[str, bytes]:
    """A filter of distinct sorted keys: the bits above ``low_bits`` choose the home slot.

    An entry takes a slot for its remainder and, if its count is above one, a slot for the count.  Entries
    move right past taken slots; ``occupied`` marks quotients that have a run, ``run_ends`` where it ends.
    """
    quotient = (keys >> np.uint64(low_bits)).astype(np.int64)
    remainder = keys & np.uint64((1 << low_bits) - 1)
    width = 1 + (counts > 1)
    before = np.cumsum(width) - width
    place = before + np.maximum.accumulate(quotient - before)
    size = int(place[-1] + width[-1])
    occupied, run_ends, counters = np.zeros((1 << SEGMENT_BITS), bool), np.zeros(size, bool), np.zeros(size, bool)
    slots = np.zeros(size, np.uint64)
    occupied[quotient] = True
    slots[place] = remainder
    many = width > 1
    slots[place[many] + 1] = counts[many].astype(np.uint64)
    counters[place[many] + 1] = True
    last = np.r_[quotient[1:] != quotient[:-1], True]
    run_ends[(place + width - 1)[last]] = True
    return {
        "occupied": np.packbits(occupied).tobytes(), "run_ends": np.packbits(run_ends).tobytes(),
        "counters": np.packbits(counters).tobytes(), "slots": slots.tobytes(),
    }


def decode(piece) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a filter in order, and their counts."""
    slots = np.frombuffer(piece["slots"], np.uint64)
    occupied, run_ends, counters = (
        np.unpackbits(np.frombuffer(piece[k], np.uint8)).astype(bool) for k in ("occupied", "run_ends", "counters")
    )
    quotient, end = np.flatnonzero(occupied), np.flatnonzero(run_ends)
    start = np.maximum(np.r_[0, end[:-1] + 1], quotient)
    length = end - start + 1
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    of = np.repeat(quotient, length).astype(np.uint64)
    entry = ~counters[at]
    keys = (of[entry] << np.uint64(int(piece["low_bits"]))) | slots[at[entry]]
    after = np.minimum(at[entry] + 1, len(slots) - 1)
    counts = np.where(counters[after] & (after > at[entry]), slots[after], np.uint64(1)).astype(np.int64)
    return keys, counts


def counting_filter(fingerprints: DataFrame) -> DataFrame:
    """One merged filter over a column of 64-bit fingerprints, a row per segment; nulls don't count."""
    (column,) = fingerprints.columns
    fingerprints = fingerprints.where(F.col(column).isNotNull())
    bits = max(SEGMENT_BITS, math.ceil(math.log2(max(2, fingerprints.count()))))
    low_bits, segment_shift = 64 - bits, 64 - bits + SEGMENT_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [counted(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for b in batches]
        if not parts:
            return
        keys, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        segment = keys >> np.uint64(segment_shift) if segment_shift < 64 else np.zeros_like(keys)
        local = keys & np.uint64((1 << segment_shift) - 1)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(keys) else []
        rows = [
            {"segment": int(segment[a]), "low_bits": low_bits, **encode(local[a:b], counts[a:b], low_bits)}
            for a, b in zip(starts, [*starts[1:], len(keys)])
        ]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def merge(pieces: pd.DataFrame) -> pd.DataFrame:
        found = [decode(p) for _, p in pieces.iterrows()]
        keys, counts = counted(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        row = {"segment": pieces["segment"].iloc[0], "low_bits": low_bits, **encode(keys, counts, low_bits)}
        return pd.DataFrame([row])

    schema = pa.schema([
        ("segment", pa.int64()), ("low_bits", pa.int32()), ("occupied", pa.binary()), ("run_ends", pa.binary()),
        ("counters", pa.binary()), ("slots", pa.binary()),
    ])
    return fingerprints.mapInArrow(build, PIECE).groupBy("segment").applyInPandas(merge, PIECE)


def repeated(filters: DataFrame) -> DataFrame:
    """The fingerprints (``fp``) that a filter counts more than once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                keys, counts = decode(piece)
                shift = piece["low_bits"] + SEGMENT_BITS
                top = (piece["segment"] << shift) & (2**64 - 1) if shift < 64 else 0
                keys = keys[counts > 1] | np.uint64(top)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["fp"])

    return filters.mapInArrow(read, "fp long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are once white space is normalised; null is the empty text, which is a text
    like others.  Of equal texts the row with the smallest id stays (``kept``); a null id is never
    the smallest unless all are null.  Of rows that repeat an id and a text, one stays.  Other columns are not
    read, so their names don't matter; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalized(F.col(text_col)).alias("norm"))
    texts = texts.withColumn("fp", F.xxhash64("norm"))
    base = materialize(
        texts.select("id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("id", "fp", "sha")
        .agg(F.count("*").cast("int").alias("rows"))
    )
    # Each id's repeats must count, too.
    twice = base.select(F.explode(F.array_repeat("fp", F.least("rows", F.lit(2)))).alias("fp"))
    again = small(materialize(repeated(counting_filter(twice))))
    groups = (
        texts.join(again, "fp", "left_semi").groupBy("fp", "norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    result = base.join(groups, ["fp", "sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    result = result.select(
        F.col("id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        "sha", F.posexplode(F.array_repeat(F.lit(0), F.col("rows"))).alias("copy", "_"),
    )
    return result.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
