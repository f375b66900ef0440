"""Importance resampling against a plain version, and the search for the k-th key."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from webposture.llm import queries, resampling

SMALL = "/root/testdata/sf0.001"


def features(text, ngram):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, percent=10, least=20, ngram=1):
    found = [(d, *features(t, ngram)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x, ngram)[1])
    S, T = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    out = []
    for doc_id, n_words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        digest = hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        score = weight + math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 2**32)))
        out.append([doc_id, len(f), weight, score, None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]


@pytest.fixture(scope="module")
def target(spark):
    return [r.text for r in queries.table(spark, SMALL, "benchmark").collect()]


@pytest.mark.parametrize(("percent", "least", "ngram"), [(10, 20, 1), (35, 1, 2), (100, 0, 1), (0, 20, 1)])
def test_whole_table(spark, rows, target, percent, least, ngram):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(docs, wanted, percent, least, ngram=ngram)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, target, percent, least, ngram)


def test_odd_rows(spark):
    twenty = " ".join(f"W{k}" for k in range(20))
    rows = [(1, None), (2, ""), (3, "?! ."), (4, twenty), (4, twenty), (4, twenty), (5, "a" * 100_000 + " b"), (None, twenty), (None, None)]
    rows += [(6, "wort Größe_x 3,4 " * 30), (7, twenty + " w1")] + [(8, twenty)] * 40
    target = [None, "", "w1 w2 größe", twenty]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rank", "'x' AS score", "2 AS n_rows").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = Counter(tuple(r) for r in resampling.resample(docs, wanted, 50).collect())
    assert got == plain(rows, target, 50)
    assert resampling.resample(docs.where("false"), wanted).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, wanted.where("false"), 50).collect()) == plain(rows, [], 50)


def test_kth_key(spark):
    """Every k, with ties in the score and rows that count several times."""
    draw = random.Random(5)
    rows = [(d, draw.randrange(4), draw.randrange(6), draw.choice([1, 1, 1, 30])) for d in range(60)]
    units = spark.createDataFrame(rows, "doc_id long, score long, n_features long, n_rows long").cache()
    order = [key for key, n in sorted(((-s, False, d, f), n) for d, s, f, n in rows) for _ in range(n)]
    for k in [1, 2, len(order) // 3, len(order) // 2, len(order)]:
        assert resampling.kth_key(units, k, pivots=3) == order[k - 1]
    assert resampling.kth_key(units, len(order) + 1, pivots=3) is None


def test_long_words(spark):
    docs = spark.createDataFrame([(k, "x" * n) for k, n in enumerate([1, 63, 64, 65, 66, 1000])], "doc_id long, text string")
    want = [zlib.crc32(b"x" * n) % 10_000 for n in [1, 63, 64, 65, 66, 1000]]
    assert sorted(want) == [b for b, n in enumerate(resampling._bucket_counts(docs.select("text"), 1, 10_000)) for _ in range(n)]
