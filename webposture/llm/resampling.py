"""Resampling towards a target distribution by hashed word features.

A document's weight is the mean gain of its features, the gain of a bucket being how much more frequent it is in the target
texts.  Weights plus Gumbel noise that depends on the id are scores, and the highest ones are drawn: sampling without
replacement in proportion to the exponential of the weight.  Tasks count and score whole Arrow columns with arrays.

The lowest drawn score is found by a distributed quickselect: pivots are random keys of what is left, every key falls before, on
or between them, and the exact counts tell which interval holds the key asked for.  Only what is drawn is sorted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.llm.text import LOWER, Words, chunks
from webposture.operators.ordering import with_rank
from webposture.session import materialize

BUCKETS = 10_000
#: The share drawn in percent, and the words a document must have for it.
PERCENT, LEAST_WORDS = 10, 20
SEED = 2024
#: Keys that a round of the search compares with.
PIVOTS = 32

#: Bytes that end a word: all ASCII but digits and letters.
_BREAKS = np.ones(256, bool)
_BREAKS[128:] = _BREAKS[48:58] = _BREAKS[65:91] = _BREAKS[97:123] = False


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(0xEDB88320), value >> 1).astype(np.uint32)
    return value


_CRC = _crc_table()


def word_buckets(words: Words, buckets: int) -> np.ndarray:
    """crc32 of each word's lower-cased bytes, modulo ``buckets``."""
    data = LOWER[words.data]
    length = words.end - words.start
    out = np.full(len(length), 0xFFFFFFFF, np.uint32)
    left = np.arange(len(length))
    for k in range(64):
        left = left[length[left] > k]
        if not len(left):
            break
        crc = out[left]
        out[left] = _CRC[(crc ^ data[words.start[left] + k]) & 255] ^ crc >> 8
    out = ~out
    for i in left[length[left] > 64] if len(left) else ():
        out[i] = zlib.crc32(data[words.start[i] : words.end[i]].tobytes())
    return out % np.uint32(buckets)


def _bucket_counts(texts: DataFrame, ngram: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs; every task sends one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in chunks(batch.column(0), _BREAKS):
                total += np.bincount(_features(words, ngram, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def _features(words: Words, ngram: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``ngram`` words, document by document, and the number of each document's."""
    n = np.diff(words.offsets)
    if ngram == 1:
        return word_buckets(words, buckets), n
    data = LOWER[words.data].tobytes()
    found, size = [], np.zeros(len(n), np.int64)
    for doc in range(words.n_docs):
        one = [data[a:b] for a, b in zip(words.start[words.offsets[doc] : words.offsets[doc + 1]], words.end[words.offsets[doc] : words.offsets[doc + 1]])]
        runs = [zlib.crc32(b" ".join(one[i : i + k])) % buckets for k in range(1, ngram + 1) for i in range(len(one) - k + 1)]
        found.append(np.array(runs, np.int64))
        size[doc] = len(runs)
    return np.concatenate([np.empty(0, np.int64), *found]), size


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", ngram: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket, in doubles.

    s and t are the bucket's features in all documents and all target texts, S and T those of all buckets.  Only one number a
    bucket reaches the driver.
    """
    s = _bucket_counts(docs.select(F.col(text_col).alias("text")), ngram, buckets).astype(float)
    t = _bucket_counts(target.select(F.col(target_text_col).alias("text")), ngram, buckets).astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**32)
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scores(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = 1, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score for each row of ``docs``."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(1), _BREAKS):
                bucket, n = _features(words, ngram, len(gain))
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                ends = np.cumsum(n)
                weight = np.where(n > 0, (total[ends] - total[ends - n]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.n_docs), pa.array(np.diff(words.offsets)), pa.array(n), pa.array(weight)],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))


def _key() -> Column:
    """What is drawn first is least: score descending, id ascending, null ids last."""
    return F.struct(
        (-F.col("score")).alias("order"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("n_features").alias("n")
    )


def kth_key(units: DataFrame, k: int, seed: int = SEED, pivots: int = PIVOTS) -> tuple | None:
    """The ``k``-th (from 1) of the keys of ``units``, a row counting ``n_rows`` times; None if there are no ``k``.

    Every round takes the ``pivots`` keys with the least random numbers of what is left and counts all of it in
    one aggregation; then as many intervals less one fall away.  When no more keys than pivots are left the key is one of them.
    """
    keyed = units.select(_key().alias("key"), "n_rows")
    low = high = None
    for turn in range(64):
        left = keyed
        if low is not None:
            left = left.where(F.col("key") > _literal(low))
        if high is not None:
            left = left.where(F.col("key") < _literal(high))
        random = F.xxhash64(F.lit(seed + turn), "key.order", "key.id", "key.n")
        found = left.select("key").orderBy(random, "key").limit(pivots).collect()
        at = sorted({tuple(r["key"]) for r in found})
        if not at:
            return None
        table = F.array(*[_literal(p) for p in at])
        # Even numbers are intervals, odd ones pivots.
        slot = F.size(F.filter(table, lambda p: p <= F.col("key"))) + F.size(F.filter(table, lambda p: p < F.col("key")))
        counts = {r["slot"]: r["n"] for r in left.groupBy(slot.alias("slot")).agg(F.sum("n_rows").alias("n")).collect()}
        for number in range(2 * len(at) + 1):
            n = counts.get(number, 0)
            if k <= n:
                break
            k -= n
        else:
            return None
        if number % 2:
            return at[number // 2]
        if number:
            low = at[number // 2 - 1]
        if number < 2 * len(at):
            high = at[number // 2]
    raise RuntimeError("the search did not narrow")


def _literal(key: tuple) -> Column:
    order, none, number, n = key
    return F.struct(
        F.lit(order).cast("long").alias("order"), F.lit(none).alias("none"), F.lit(number).cast("long").alias("id"), F.lit(n).cast("long").alias("n")
    )


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text",
    target_text_col: str = "text", ngram: int = 1, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null if not drawn).

    Of the N rows with ``least_words`` words or more the floor(``percent`` * N / 100) highest scores are drawn; ties go to the
    smaller id, null ids last, then to fewer features.  Rows that repeat id, features and score count one by one and draw different ranks.  Null
    and empty texts have no features and weight 0.  An empty target or table leaves the counts 0, with no other effect.
    Other columns are not read.
    """
    gain = gains(docs, target, text_col, target_text_col, ngram, buckets)
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    units = materialize(scores(docs, gain, id_col, text_col, ngram, seed).groupBy(*columns).agg(F.count("*").alias("n_rows")))
    able = units.where(F.col("n_words") >= least_words)
    n = able.agg(F.sum("n_rows")).first()[0] or 0
    k = percent * n // 100
    last = kth_key(able, k, seed) if k else None
    drawn = F.lit(False) if last is None else (F.col("n_words") >= least_words) & (_key() <= _literal(last))
    one = units.withColumn("drawn", drawn).select("*", F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("copy"))
    out = one.where("NOT drawn").select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if last is None:
        return out
    winners = one.where("drawn").select("doc_id", "n_features", "weight", "score", (-F.col("score")).alias("order"), F.col("doc_id").isNull().alias("none"), "copy")
    ranked = with_rank(winners, [], ["order", "none", "doc_id", "n_features", "copy"])
    rank = F.when(F.col("rank") < k, F.col("rank") + 1).cast("long")
    return out.unionByName(ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank")))
