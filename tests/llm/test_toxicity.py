"""Toxicity: the scores against a plain version of the method, whole texts in training, and held-out labels."""

from __future__ import annotations

import re

import numpy as np
import pytest
import zstandard

from webposture.llm import queries, toxicity

SMALL, TABLE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels").select("doc_id", "toxic")
    return docs, toxicity.train(docs, labels)


def plain_score(model, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0.0
    parameters = zstandard.ZstdCompressionParameters(**toxicity._PARAMETERS)
    first = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model.ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
    second = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model.toxic + model.ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters)
    saved = []
    whole = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", whole)]
    for k in range(0, len(spans), toxicity.WINDOW):
        part = spans[k : k + toxicity.WINDOW]
        window = b" " + re.sub(rb"[\x09-\x0D]", b" ", whole[part[0][0] : part[-1][1]]) + b" "
        saved.append(len(first.compress(window)) - len(second.compress(window)))
    n = len(saved)
    found = [sum(s >= k for s in saved) for k in toxicity.SAVED]
    x = np.array([*(np.log1p(f) for f in found), *(f / (n + 3) for f in found), np.log1p(n)])
    z = ((x - model.mean) / model.spread) @ model.weights[1:] + model.weights[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores(trained):
    docs, model = trained
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert len(got) == len(texts) and all(abs(got[d] - plain_score(model, t)) < 1e-9 for d, t in texts.items())


def test_dictionaries_are_trained(trained):
    _, model = trained
    magic = (0xEC30A437).to_bytes(4, "little")
    assert model.ordinary.startswith(magic) and model.toxic.startswith(magic)


def test_training_reads_whole_texts(spark):
    """What makes the toxic documents toxic comes at the end of long texts."""
    filler = " ".join(f"common{k % 40} plain{k % 17}" for k in range(9000))
    bad = "vilexa morbund grawl skithe"
    rows = [(k, f"{filler} tail{k % 5} " + (f"{bad} {bad} you grawl {bad}" if k % 2 else "the end of it")) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = toxicity.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic"))
    more = spark.createDataFrame([(1, f"{filler} grawl skithe vilexa morbund grawl"), (2, filler)], "doc_id long, text string")
    scores = {r.id: r.score for r in toxicity.toxicity(more, model).collect()}
    assert b"grawl" in model.toxic and scores[1] > 0.5 > scores[2]


def test_held_out_labels(spark):
    """Seven in ten of the toxic documents that training did not see, and two in a hundred others at most."""
    scored = queries.op3_toxicity(spark, TABLE).where("held_out")
    labels = queries.table(spark, TABLE, "labels").where("toxic IS NOT NULL").select("doc_id", "toxic")
    found = scored.join(labels, "doc_id").groupBy("toxic").avg("predicted").collect()
    rates = {r["toxic"]: r[1] for r in found}
    print(rates)
    assert rates[1] > 0.6 and rates[0] < 0.03
