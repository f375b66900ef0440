"""Collocations against a plain count, with all numbers in memory and with most of them beyond."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from webposture.llm import collocations, queries

SMALL = "/root/testdata/sf0.001"


def plain(rows, longest=5, least=100, percent=100, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    candidates = {k: n for k, n in counts.items() if len(k[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, phrase), n in candidates.items():
        for size in range(2, len(phrase)):
            for i in range(len(phrase) - size + 1):
                inside[lang, phrase[i : i + size]] = max(inside[lang, phrase[i : i + size]], n)
    out = {}
    for (lang, phrase), a in candidates.items():
        if inside[lang, phrase] and 100 * inside[lang, phrase] >= percent * a:
            continue
        cuts = [(counts[lang, phrase[:k]], counts[lang, phrase[k:]]) for k in range(1, len(phrase))]
        score, k = min((1000 * a * totals[lang] // (l * r), k) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), *cuts[k], totals[lang]))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, n, -s)
        for lang, found in out.items() for rank, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1)
    )


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.text, r.lang) for r in queries.table(spark, SMALL, "documents").select("text", "lang").collect()]


@pytest.mark.parametrize("head", [collocations.HEAD, 40, 0])
def test_whole_table(spark, rows, head):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = plain(rows, least=12)
    assert len(want) > 100 and any(len(r[2].split()) > 2 for r in want)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=12, head=head).collect()) == want


def test_options(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    got = collocations.collocations(docs, longest=3, least=20, percent=60, top=7).collect()
    assert sorted(tuple(r) for r in got) == plain(rows, 3, 20, 60, 7) != []


def test_odd_rows(spark):
    repeat = "Alpha beta, gamma delta: gamma delta!\tgamma  delta\x0bomega " * 60
    rows = [
        (None, "en"), ("", None), (" \n.", "en"), (repeat, "en"), (repeat, None), (repeat, "und"), (repeat, "x y"), ("same " * 400, "fr"),
        ("a b c d e f g " * 150, "zz"), ("été été " * 120, "zz"), ("long" * 50_000, "en"), ("ab cd ef " * 130, "nb"),
    ]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS rank", "'y' AS id").repartition(3)
    want = plain(rows)
    assert {r[0] for r in want} == {"en", "und", "x y", "fr", "zz", "nb"} - {r for r in ("en", "x y") if r not in {w[0] for w in want}}
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == want
    assert collocations.collocations(docs.where("false")).count() == 0


def test_dense_and_sparse_tiles():
    """The same counts by direct address, by coordinates and for hashes."""
    random = np.random.default_rng(3)
    a, b = random.zipf(1.3, 400_000) % 5000, random.zipf(1.3, 400_000) % 5000
    a[::50] |= collocations._HASHED
    x, y, n = collocations.count_pairs(a, b)
    assert np.bincount(a[a < 1024] * 0).sum() > collocations.DENSE
    want = Counter(zip(a.tolist(), b.tolist()))
    assert len(x) == len(want) and dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) == want


def test_exact_beyond_64_bits(spark):
    """Products past 64 bits, and a division whose double would round up."""
    from pyspark.sql import functions as F

    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(1000 * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    cases = [(10**11, 10**13, 10**12 + 7, 10**12 + 9), (3 * 10**9, 7 * 10**12, 10**10 + 3, 9 * 10**9)]
    got = spark.createDataFrame(cases, "a long, n long, l long, r long").select(score).collect()
    assert [r[0] for r in got] == [1000 * a * n // (l * r) for a, n, l, r in cases]
