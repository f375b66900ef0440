"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import hashlib
import re

import pytest

import corpus_pipeline
from webposture.llm import (
    decontaminate, exact_dedup, licenses, line_dedup, lm_score, mixing, near_dedup, substring_dedup, token_store, toxicity,
)
from webposture.llm.queries import tokenizer_path

LONG = " ".join(f"w{k % 977}x{k % 13}" for k in range(60_000))
TEXT = " ".join(f"word{k}" for k in range(40))
ROWS = [
    (1, TEXT, "en", "a", 1), (2, TEXT, "en", "a", 1), (2, TEXT, "en", "a", 1), (3, TEXT + " more", None, "b", None),
    (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \t\n", "en", None, 3), (None, TEXT, "en", "a", 1),
    (None, None, None, None, None), (7, LONG, "en", "b", 9), (8, LONG + " end", "fr", "b", 9), (9, "one", "en", "c", 3),
    (10, "Released under the MIT License.\nÉté à la plage", "fr", "c", 3),
]
#: Names that the operators use themselves.
CLASH = ["id", "row", "text_hash", "key", "n", "rep", "label", "__id", "copies", "fp"]


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASH:
        table = table.selectExpr("*", f"'x' AS {name}")
    return table


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(f"WORD{k}," for k in range(10, 30)), "x"), (2, None, "x"), (3, "", "x"), (4, "one", "x"), (None, TEXT, "x")]
    return spark.createDataFrame(rows, "item_id long, text string, seed string")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1), (2, 0), (3, None), (None, 1), (5, 0), (7, 0), (7, 0)]
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_dedup(docs, none):
    got = by_id(exact_dedup.exact_duplicates(docs))
    assert len(got) == len(ROWS)
    of_text = [r for r in got if r[4] == hashlib.sha256(TEXT.encode()).hexdigest()]
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in of_text) == [(0, 1, 4, False), (1, 1, 4, True), (2, 1, 4, False), (2, 1, 4, False)]
    empty = [r for r in got if r[4] == hashlib.sha256(b"").hexdigest()]
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in empty) == [(0, 4, 3, False), (4, 4, 3, True), (5, 4, 3, False)]
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_keeps_one_of_rows_that_repeat(docs):
    twice = by_id(exact_dedup.exact_duplicates(docs.where("doc_id = 2")))
    assert [(r[1], r[2], r[3]) for r in twice] == [(2, 2, False), (2, 2, True)]


def test_near_dedup(docs, none):
    got = {r[0]: r[1:] for r in by_id(near_dedup.near_duplicates(docs, 2)) if r[0] is not None}
    assert got[2] == (39, 1, False) and got[3] == (40, 1, False) and got[1] == (39, 1, True)
    assert got[4] == (0, 4, True) and got[6] == (0, 6, True) and got[9] == (1, 9, True)
    assert got[8][1:] == (7, False)
    assert near_dedup.near_duplicates(docs, 2).count() == len(ROWS)
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10]
    assert near_dedup.near_duplicates(none).count() == 0


def test_decontaminate(docs, none, benchmark):
    got = {(r[0], r[1]) for r in by_id(decontaminate.contamination(docs, benchmark))}
    assert got == {(d, i) for d in (1, 2, 3, None) for i in (1, None)}
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8, 9, 10][1:]
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.where("false")).count() == 0


def test_mixing(docs, none):
    got = by_id(mixing.mix_report(docs))
    assert len(got) == len(ROWS) and all(0 <= r[4] <= 3 * r[1] for r in got)
    assert sum(r[1] for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in ROWS)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0


def test_substring_dedup(docs, none):
    got = by_id(substring_dedup.drop_repeated_windows(docs))
    assert len(got) == len(ROWS)
    assert [r[1:3] for r in got if r[0] == 2] == [(40, 40)] * 2 and [r[1:3] for r in got if r[0] == 3] == [(41, 40)]
    assert [r[1:3] for r in got if r[0] is None] == [(0, 0), (40, 40)] and [r[1:3] for r in got if r[0] in (4, 5, 6, 9)] == [(0, 0), (0, 0), (0, 0), (1, 0)]
    assert substring_dedup.drop_repeated_windows(none).count() == 0


def test_lm_score(docs, none):
    model = lm_score.train(docs)
    got = by_id(lm_score.scores(docs, model))
    assert len(got) == len(ROWS) and all(r[4] < 0 and r[5] < 0 for r in got)
    assert [r[1] for r in got if r[0] in (4, 5, 6)] == [1, 1, 1]
    assert lm_score.scores(none, model).count() == 0
    untrained = lm_score.train(none)
    assert all(r[2] == 0 and r[3] == 0 for r in by_id(lm_score.scores(docs, untrained)))


def test_token_store(docs, none):
    got = by_id(token_store.token_offsets(docs, tokenizer_path))
    assert len(got) == len(ROWS) and [r[2] for r in got if r[0] in (4, 5, 6)] == [1, 1, 1]
    in_order = sorted(got, key=lambda r: r[1])
    assert [r[0] for r in in_order] == [None, None] + [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10] and in_order[0][1] == 0
    assert all(a[1] + a[2] == b[1] for a, b in zip(in_order, in_order[1:]))
    assert token_store.token_offsets(none, tokenizer_path).count() == 0


def test_toxicity(docs, none, labels):
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.toxicity(docs, model))
    assert len(got) == len(ROWS) and all(0 <= r[1] <= 1 for r in got) and all(r[1] == 0 for r in got if r[0] in (4, 5, 6))
    assert toxicity.train(docs, labels.where("false")) is None and toxicity.train(none, labels) is None
    assert toxicity.toxicity(docs, None).count() == len(ROWS)
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(none, model).count() == 0


def test_licenses(docs, none):
    assert [r[:3] for r in by_id(licenses.license_matches(docs))] == [(10, "MIT-notice", 1.0)]
    assert licenses.license_matches(none).count() == 0 and licenses.license_matches(docs, {}).count() == 0


def test_line_dedup(docs, none):
    got = {r[:2]: r[2:] for r in by_id(line_dedup.similar_lines(docs))}
    assert got == {(2, 0): (1, 0), (3, 0): (1, 0), (None, 0): (1, 0), (8, 0): (7, 0)}
    assert line_dedup.similar_lines(none).count() == 0


def test_pipeline_stages(spark, docs, none, benchmark, labels, tmp_path):
    """Every stage on odd rows and on none."""
    folder = str(tmp_path)
    labels.selectExpr("*", "1 AS quality").write.parquet(f"{folder}/labels.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert stage(spark, none, folder).count() == 0
        if name != "token_output":
            assert out.columns == docs.columns
        assert out.count() <= 3 * len(ROWS)


def test_a_source_at_its_limit_gives_no_fourth_copy(spark):
    """One small source has three times its size as target; its empty documents come three times too."""
    rows = [(k, "w " * 50, "big") for k in range(40)] + [(100 + k, "w " * 5, "small") for k in range(4)] + [(200 + k, ["", None][k % 2], "small") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.decisions(docs, weights=(1, 3)).collect()
    assert {r.copies for r in found if r.source == "small"} == {3}
    assert mixing.mix(docs, weights=(1, 3)).where("source = 'small'").count() == 30


def test_a_long_text_takes_no_more_than_its_share(spark, benchmark):
    """Twice the words take about twice the time, with hits all over the text."""
    import time

    def seconds(n):
        text = " ".join(f"w{k % 4999}" if k % 50 > 20 else f"word{10 + k % 50}" for k in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        begun = time.time()
        assert {r.item_id for r in decontaminate.contamination(docs, benchmark).collect()} >= {1}
        return time.time() - begun

    seconds(1000)
    small, large = seconds(40_000), seconds(160_000)
    assert large < 4 * small + 8


def test_a_phrase_of_very_many_items(spark):
    """Items that share a phrase are one block, which is too large for a broadcast."""
    same = " ".join(f"c{k}" for k in range(13))
    items = spark.range(500).selectExpr("id AS item_id", f"concat('{same} ', 'own', id, ' tail', id) AS text")
    docs = spark.createDataFrame([(1, "x y " + same + " z"), (2, "c0 c1 c2 c3"), (3, same.replace("c5", "other"))], "doc_id long, text string")
    size = decontaminate.BLOCK_SEEDS
    decontaminate.BLOCK_SEEDS = 300
    try:
        found = decontaminate.contamination(docs, items)
        got = sorted((r.doc_id, r.item_id, r.equal_words) for r in found.collect())
        assert "BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        decontaminate.BLOCK_SEEDS = size
    assert got == sorted([(1, k, 13) for k in range(500)] + [(3, k, 12) for k in range(500)])
