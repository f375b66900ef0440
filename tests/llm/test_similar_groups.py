"""Large groups of similar lines, whose word lists are compared in blocks, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from webposture.llm import line_dedup
from webposture.llm.text import chunks

LINES, WORDS = 5000, 40


@pytest.mark.parametrize("hot", [line_dedup.HOT, 100])
def test_group_in_blocks(spark, monkeypatch, hot):
    """Lines that differ from one in up to six words: more than a block holds, and not all similar to all; with hot words, too."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(7)
    removed = np.zeros((LINES, WORDS), np.int64)
    for row in removed:
        row[rng.choice(WORDS, rng.integers(2, 7), replace=False)] = 1
    lines = [" ".join(f"own{k}x{w}" if gone else f"word{w}" for w, gone in enumerate(row)) for k, row in enumerate(removed)]
    docs = spark.createDataFrame([(d, "\n".join(lines[10 * d : 10 * d + 10])) for d in range(LINES // 10)], "doc_id long, text string")
    n = removed.sum(1)
    common = WORDS - (n[:, None] + n[None, :] - removed @ removed.T)
    similar = np.tril(common * 100 >= 80 * (2 * WORDS - common), -1)
    gone = np.flatnonzero(similar.any(1))
    want = {(k // 10, k % 10): (e // 10, e % 10) for k, e in zip(gone.tolist(), similar.argmax(1)[gone].tolist())}
    assert 1000 < len(want) < LINES and len(set(want.values())) > 10
    rows = line_dedup.similar_lines(docs.repartition(5)).collect()
    assert len(rows) == len(want)
    assert {(r[0], r[1]): (r[2], r[3]) for r in rows} == want


def test_keys_and_places():
    """Hashes of words by eight bytes: the same for the same word wherever it stands; places as by binary search."""
    words = ["a", "A", "ab", "abcdefgh", "abcdefghi", "b" * 63, "b" * 64, "b" * 65, "x" * 5000, "é", "ab\x00", "ab\x00\x00", "abcdefgh\x00"]
    texts = [" ".join(words), "\n\n".join(reversed(words)) + "\t", "", None, "a" * 100_000, "z" + " ".join(words)]
    seen: dict[str, set[int]] = {}
    for found in chunks(pa.array(texts)):
        for name, key in zip(found.strings(np.arange(len(found.start))), found.keys().tolist()):
            seen.setdefault(name, set()).add(key)
        lower = dict(zip(found.strings(np.arange(len(found.start))), found.keys(lower=True).tolist()))
        assert lower["a"] == lower["A"] != lower["ab"]
    assert seen.keys() == {*words, "a" * 100_000, "za"} and all(len(x) == 1 for x in seen.values())
    assert len({k for x in seen.values() for k in x}) == len(seen)

    rng = np.random.default_rng(3)
    head = np.unique(np.r_[rng.integers(0, 2**64, 3000, np.uint64), np.arange(50, dtype=np.uint64), np.uint64(2**64 - 1)])
    asked = np.r_[head, rng.integers(0, 2**64, 3000, np.uint64), np.uint64(2**64 - 1), np.uint64(0)]
    assert (line_dedup._place(head, line_dedup._cells(head), asked) == np.searchsorted(head, asked)).all()
    less = head[:-1]
    assert (line_dedup._place(less, line_dedup._cells(less), asked) == np.searchsorted(less, asked)).all()
