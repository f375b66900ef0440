"""Toxic text by compression distance.

Two zstandard dictionaries are trained: one on windows of ordinary text, one on the text of toxic documents without the words that ordinary
documents have, too.  Every window of a document is compressed with both; the bytes that the toxic one saves are
the evidence, and a calibrated threshold on the windows' evidence decides.  For compression the toxic dictionary ends in the ordinary
one, so that ordinary words cost the same in both and only toxic ones make a difference.

The sample is bounded by its rows alone.  Their whole texts are read by tasks; what reaches the driver is ordinary windows
of a fixed number, the words and pieces of words that only toxic documents have, and the evidence of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.text import LOWER, SPACE, Words, chunks
from webposture.session import materialize

#: The training sample: so many toxic and ordinary rows at most, chosen by a hash of their ids.
TOXIC_ROWS, ORDINARY_ROWS = 1500, 4500
#: Windows that the ordinary dictionary is trained on, chosen by a hash.
ORDINARY_WINDOWS = 30_000
#: Words of a window.
WINDOW = 16
DICTIONARY_BYTES = 32_768
#: Ordinary words are left out of the toxic text.  A word stays if toxic documents have one of its beginnings so many times as often as
#: ordinary ones, and such a share of them has it at least.  Of these settings and sizes of the toxic dictionary the one
#: that does best on rows set apart is taken.
SETTINGS = ((150, 0.02), (60, 0.02), (20, 0.01), (8, 0.01))
TOXIC_BYTES = (512, 2048, 8192)
#: Saved bytes from which a window counts, one feature each.
SAVED = (1, 2, 3, 4, 5, 6)

_FOLD = LOWER.copy()
_FOLD[SPACE] = 32
_PARAMETERS = {
    "window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 5, "min_match": 4, "target_length": 8,
    "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0,
}


def windows(words: Words, doc: int) -> Iterator[bytes]:
    """Runs of ``WINDOW`` words of a document, lower-cased, each with white space around."""
    a, b = words.offsets[doc], words.offsets[doc + 1]
    for i in range(a, b, WINDOW):
        run = words.data[words.start[i] : words.end[min(i + WINDOW, b) - 1]]
        yield b" " + _FOLD[run].tobytes() + b" "


def texts_of(columns: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The windows of each text of a column."""
    for words in chunks(columns):
        for doc in range(words.n_docs):
            yield words.first + doc, list(windows(words, doc))


def _pieces(word: bytes) -> set[bytes]:
    """How a word begins."""
    return {b" " + word[:k] for k in range(3, min(len(word), 9) + 1)}


def _document_pieces(text: list[bytes]) -> set[bytes]:
    return {p for word in set(b" ".join(text).split()) for p in _pieces(word)}


def _design(evidence: np.ndarray) -> np.ndarray:
    n, k = evidence[:, :1], evidence[:, 1:]
    return np.hstack([np.log1p(k), k / (n + 3), np.log1p(n)])


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @cached_property
    def _compressors(self) -> tuple:
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            made.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters))
        return tuple(made)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_compressors"}

    def evidence(self, text: list[bytes]) -> list[int]:
        """The number of windows, and of those that the toxic dictionary saves 1, 2, ... bytes."""
        plain, toxic = (c.compress for c in self._compressors)
        saved = [len(plain(w)) - len(toxic(w)) for w in text]
        return [len(saved), *(sum(s >= k for s in saved) for k in SAVED)]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        """0 for texts without words."""
        if not len(evidence):
            return np.empty(0)
        z = (_design(evidence) - self.mean) / self.spread @ self.weights[1:] + self.weights[0]
        return np.where(evidence[:, 0] > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def _calibrate(model: Model, evidence: np.ndarray, toxic: np.ndarray) -> float:
    """Logistic regression on the windows' evidence by Newton steps; returns the mean loss."""
    x = _design(evidence)
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - model.mean) / model.spread])
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.3
    ridge[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - ridge @ w
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, slope)
    model.weights = w
    p = np.clip(model.probability(evidence), 1e-6, 1 - 1e-6)
    return float(-np.log(np.where(toxic, p, 1 - p)).mean())


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(samples)[-size:]


def _toxic_pieces(pieces: dict[bytes, tuple[int, int]], n: tuple[int, int], times: float, share: float) -> set[bytes]:
    """Pieces that toxic documents have so many times as often; ``pieces``: in how many toxic and ordinary ones, of ``n`` each."""
    return {
        p for p, (toxic, plain) in pieces.items()
        if toxic >= max(3, share * n[0]) and (toxic + 0.5) / (n[0] + 1) >= times * (plain + 0.5) / (n[1] + 1)
    }


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The training sample: order, apart (for calibration), toxic, text.

    ``labels``: doc_id and toxic (0 or 1); a null label or id is no label, and an id labelled twice is toxic if one
    label says so.  The sample's ids are a few thousand, so they are broadcast.
    """
    one = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(7), "doc_id")
    ids = [
        one.where(F.col("toxic") == c).select("doc_id", "toxic", order.alias("order")).orderBy("order").limit(most)
        for c, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))
    ]
    ids = materialize(ids[0].union(ids[1])).select(F.col("doc_id").alias("id"), "toxic", "order")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id")
    return materialize(rows.select("order", (F.pmod("order", F.lit(3)) == 0).alias("apart"), (F.col("toxic") == 1).alias("toxic"), "text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from a bounded sample of the labelled rows; None if either class has no row.

    Two thirds of the sample give the dictionaries, the others choose and calibrate; where these lack a class, all do both.  Null and empty
    texts are documents without windows.
    """
    rows = sample_rows(docs, labels, id_col, text_col)
    size = {(r["apart"], r["toxic"]): r["n"] for r in rows.groupBy("apart", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(size.get((False, c), 0) + size.get((True, c), 0) for c in (False, True)):
        return None
    learn, check = rows.where("NOT apart"), rows.where("apart")
    if not all(size.get((a, c), 0) for a in (False, True) for c in (False, True)):
        learn = check = rows
        size = {(False, c): size.get((False, c), 0) + size.get((True, c), 0) for c in (False, True)}
    n = size[False, True], size[False, False]

    def some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in texts_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(text), pa.int64())), pa.array(range(len(text)), pa.int64()), pa.array(text, pa.binary())], names=["order", "at", "w"])

    plain = learn.where("NOT toxic").select("order", "text").mapInArrow(some_windows, "order long, at long, w binary")
    plain = plain.select(F.xxhash64("order", "at").alias("key"), "w").orderBy("key", "w").limit(ORDINARY_WINDOWS).collect()
    ordinary = _dictionary(DICTIONARY_BYTES, [bytes(r["w"]) for r in plain])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in texts_of(batch.column(1)):
                found = list(_document_pieces(text))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.binary())], names=["toxic", "piece"])

    counted = learn.select("toxic", "text").mapInArrow(pieces_of, "toxic boolean, piece binary").groupBy("piece").agg(
        F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("p")
    )
    times, share = min(t for t, _ in SETTINGS), min(s for _, s in SETTINGS)
    rare = (F.col("t") + 0.5) / (n[0] + 1) >= times * (F.col("p") + 0.5) / (n[1] + 1)
    counted = {bytes(r["piece"]): (r["t"], r["p"]) for r in counted.where((F.col("t") >= max(3.0, share * n[0])) & rare).collect()}
    wanted = set(counted)

    def toxic_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in texts_of(batch.column(1)):
                found = list(dict.fromkeys(word for w in text for word in w.split() if _pieces(word) & wanted))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.binary()))], names=["order", "words"])

    toxic = learn.where("toxic").select("order", "text").mapInArrow(toxic_words, "order long, words array<binary>")
    toxic = [[bytes(w) for w in r["words"]] for r in sorted(toxic.collect(), key=lambda r: (r["order"], len(r["words"])))]
    models = []
    for setting in SETTINGS:
        chosen = _toxic_pieces(counted, n, *setting)
        samples = [b" " + b" ".join(kept) + b" " for words in toxic if (kept := [w for w in words if _pieces(w) & chosen])]
        models += [Model(ordinary, _dictionary(k, samples), np.zeros(1), np.ones(1), np.zeros(2)) for k in TOXIC_BYTES]

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in texts_of(batch.column(1)):
                found = [x for model in models for x in model.evidence(text)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found], pa.list_(pa.int64()))], names=["toxic", "found"])

    found = sorted((r["toxic"], tuple(r["found"])) for r in check.select("toxic", "text").mapInArrow(evidence, "toxic boolean, found array<long>").collect())
    truth, table = np.array([t for t, _ in found]), np.array([x for _, x in found], float).reshape(len(found), len(models), -1)
    losses = [_calibrate(model, table[:, k], truth) for k, model in enumerate(models)]
    return models[int(np.argmin(losses))]


def toxicity(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1), the model's probability that the text is toxic, for each row of ``docs``.

    All windows of all texts count.  A text without words, or null, scores 0, and so does every text if there
    is no model.  Repeated rows score alike; other columns are not read.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [model.evidence(text) for _, text in texts_of(batch.column(1))] if model else []
            scores = model.probability(np.array(evidence, float).reshape(-1, 1 + len(SAVED))) if model else np.zeros(len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model scores below one half, all columns as they are, whatever their names.

    Null texts and such without words stay, rows that repeat a text share its fate, and without a model all rows stay.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evidence = [model.evidence(text) for _, text in texts_of(batch.column(at))]
            scores = model.probability(np.array(evidence, float).reshape(-1, 1 + len(SAVED)))
            yield batch.filter(pa.array(scores < 0.5))

    if model is None:
        return docs
    at = docs.columns.index(text_col)
    return docs.mapInArrow(keep, docs.schema)
