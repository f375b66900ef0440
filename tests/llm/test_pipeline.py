"""The pipeline's rows on a whole small table against a plain version of every stage."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from .test_brute_force import WORD, component_of, lower
from .test_toxicity import plain_score
from webposture.llm import queries, toxicity

SMALL = "/root/testdata/sf0.001"


def kept_of_near_copies(texts):
    sets = {}
    for d, text in texts.items():
        w = WORD.findall(lower(text))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    links = [
        (a, b) for a, b in combinations(sets, 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    component = component_of(sets, links)
    return {d: t for d, t in texts.items() if component[d] == d}


def holds(doc, item):
    if len(item) < 13:
        return len(item) >= 5 and any(doc[i : i + len(item)] == item for i in range(len(doc)))
    doc, item = np.array(doc), np.array(item)
    for shift in range(13 - len(item), len(doc) - 12):
        a, b = max(0, -shift), min(len(item), len(doc) - shift)
        equal = np.convolve(doc[a + shift : b + shift] == item[a:b], np.ones(13, int), "valid") if b - a >= 13 else []
        if len(equal) and max(equal) >= 11:
            return True
    return False


def copies(rows, rate):
    size = {d: len(WORD.findall(t or "")) for d, t, _ in rows}
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    of = {s: [d for d, _, x in rows if x == s] for s in names}
    total = {s: sum(size[d] for d in of[s]) for s in names}
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(total.values())), list(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * total[s]]
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full] if full else []
    out = {}
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        key = lambda d: -math.log((int(hashlib.md5(str(d).encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / rate.get(d, 1.0)
        for d in sorted(of[s], key=lambda d: (key(d), d)):
            out[d] = epochs + (epochs < 3 and 2 * before + size[d] <= 2 * rest)
            before += size[d]
    return out


def test_pipeline(spark):
    documents, labels = queries.table(spark, SMALL, "documents"), queries.table(spark, SMALL, "labels").collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    learned = spark.createDataFrame([(r.doc_id, r.toxic) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5], "doc_id long, toxic int")
    model = toxicity.train(documents, learned)
    texts = {r.doc_id: r.text for r in documents.collect()}
    texts = {d: t for d, t in texts.items() if model is None or plain_score(model, t) < 0.5}
    texts = kept_of_near_copies(texts)
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    items = [words(r.text) for r in queries.table(spark, SMALL, "benchmark").collect()]
    found = {d for d, t in texts.items() if any(holds(words(t), i) for i in items)}
    assert found
    texts = {d: t for d, t in texts.items() if d not in found}
    rate = {r.doc_id: 1.0 if r.quality >= 1 else 0.25 for r in labels if r.quality is not None}
    taken = copies([(d, t, source[d]) for d, t in texts.items()], rate)
    tokenizer, start, want = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for d in sorted(texts):
        for _ in range(taken[d]):
            ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want and len(want) > 100
