"""Order MinHash against a plain version with the same hash function."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
import xxhash

from webposture.llm import order_minhash, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_hash(*values, kinds):
    seed = 42
    for value, kind in zip(values, kinds):
        data = value.encode() if kind == "s" else (value % 2 ** (64 if kind == "l" else 32)).to_bytes(8 if kind == "l" else 4, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def plain(text, size=order_minhash.KMER, tuple_size=order_minhash.TUPLE, slots=order_minhash.SLOTS):
    bits = order_minhash.AT_BITS
    words = [spark_hash(w, kinds="s") for w in WORD.findall(text or "")]
    if not words:
        return [0] * slots
    if len(words) >= size:
        kmers = [spark_hash(*words[i : i + size], kinds="l" * size) for i in range(len(words) - size + 1)]
    else:
        kmers = [spark_hash(*words, kinds="l" * len(words))]
    seen, circle = {}, []
    for at, kmer in enumerate(kmers):
        short = signed(kmer << bits & 2**64 - 1) >> bits
        occurrence = seen[short] = seen.get(short, -1) + 1
        place = spark_hash(short, occurrence, kinds="li")
        circle.append((signed(place << bits & 2**64 - 1) | at, at))
    circle.sort()
    out = []
    for slot in range(slots):
        point = slot * (2**64 // slots) - 2**63
        first = sum(c[0] < point for c in circle)
        chosen = sorted(circle[(first + k) % len(circle)][1] for k in range(tuple_size))
        out.append(spark_hash(*[kmers[at] for at in chosen], kinds="l" * tuple_size) >> 32)
    return out


def as_text(values):
    return "".join(f"{v % 2**32:08x}" for v in values)


def likeness(a, b):
    return sum(x == y for x, y in zip(a, b)) / len(a)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in order_minhash.edit_report(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r))
    order = sorted({(d, t or "") for d, t in rows}, key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1], kinds="s")))
    following = {a: b[1] for a, b in zip(order, order[1:] + order[:1])}
    want = []
    for doc_id, text in rows:
        text = text or ""
        third, near = len(text) // 3, following[doc_id, text]
        edited = text[: len(text) - third] + near[:third]
        own, other, next_ = plain(text), plain(edited), plain(near)
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(other), likeness(own, other), likeness(own, next_)))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    check(spark, [r for r in rows if len(r[1] or "") < 6000])


def test_odd_texts(spark):
    check(spark, [
        (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n "), (5, "one"), (6, "same " * 500), (7, "a b " * 300), (8, "été 🙂 plage"),
        (8, "another text of the same id"), (8, "another text of the same id"), (None, "no id at all"), (None, None), (9, "x" * 5000),
    ])


@pytest.mark.parametrize("rows", [[], [(1, "only one text here")], [(None, None)]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_order_counts(spark):
    """A text whose halves change places is less like the original than plain MinHash says; a small edit leaves most."""
    words = [f"w{k}" for k in range(400)]
    shuffled = [w for k in range(0, 400, 4) for w in words[k : k + 4]]
    blocks = [words[k : k + 4] for k in range(0, 400, 4)]
    random.Random(1).shuffle(blocks)
    texts = [" ".join(words), " ".join(words[:200] + ["new"] + words[201:]), " ".join(w for b in blocks for w in b), " ".join(words[200:] + words[:200])]
    assert shuffled == words
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.fingerprint for r in order_minhash.fingerprints(docs).collect()}
    values = {d: [f[k : k + 8] for k in range(0, len(f), 8)] for d, f in found.items()}
    assert likeness(values[0], values[1]) > 0.9
    # Three quarters less of the k-mers, and about half of the pairs in another order.
    assert likeness(values[0], values[2]) < 0.5
    assert likeness(values[0], values[3]) < 0.75


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "d e f", 6, "y")], "doc_id long, text string, rank int, hash string")
    assert [tuple(r)[:2] for r in sorted(order_minhash.edit_report(docs).collect())] == [(1, 5), (2, 5)]
