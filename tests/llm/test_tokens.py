"""What the token files check: the width of ids, and whether a tokenizer may be run word by word."""

from __future__ import annotations

import json

import numpy as np
import pytest

from webposture.llm import token_store
from webposture.llm.queries import tokenizer_path


def test_ids_that_are_too_wide(tmp_path):
    writer = token_store.ShardWriter(str(tmp_path), "x", 2)
    writer.add([1], np.array([65_535], np.uint32), np.array([1]))
    with pytest.raises(ValueError, match="65536"):
        writer.add([2], np.array([65_536], np.uint32), np.array([1]))


def test_a_tokenizer_that_looks_at_white_space(spark, tmp_path):
    """Its texts are encoded whole, and come out as the library encodes them."""
    from tokenizers import Tokenizer

    assert token_store.WordEncoder(tokenizer_path()).by_word
    vocabulary = {c: k for k, c in enumerate([*"abcdefghijklmnopqrstuvwxyz ", "[UNK]", "a ", "b c"])}
    path = str(tmp_path / "spaces.json")
    model = {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}
    split = {"type": "Split", "pattern": {"Regex": "a |b c|."}, "behavior": "Isolated", "invert": False}
    with open(path, "w") as out:
        json.dump({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": split, "post_processor": None, "decoder": None, "model": model}, out)
    assert not token_store.WordEncoder(path).by_word
    texts = {1: "a b c", 2: "", 3: None, 4: "b  c a x"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.n_tokens for r in token_store.token_offsets(docs, path).collect()}
    plain = Tokenizer.from_file(path)
    assert found == {d: len(plain.encode(t or "").ids) + 1 for d, t in texts.items()}
