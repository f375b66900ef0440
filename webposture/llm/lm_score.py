"""Language-model scores by prediction by partial matching over bytes.

The training texts' byte contexts of up to ``ORDER`` bytes form a trie with counts.  A byte is coded in the longest
context that the trie knows.  There, method C estimates the escape: a context seen n times with q different
bytes after it gives a byte seen c times c / (n + q), and q / (n + q) to the escape to the next shorter context.
Symbols that the longer context knows cannot follow an escape, so they are excluded: the shorter context's
probabilities are divided by what they leave.  The trie is fixed when texts are scored (pretrained), so the code
length of each (context, byte) in the trie and the cost of each escape are worked out beforehand, and scoring a
text is a table lookup per byte.

A text is its lower-cased words with a space between and a line feed at the end, and starts after line feeds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.llm.tables import count_floor, small
from webposture.llm.text import LOWER, Words, chunks, counted
from webposture.session import materialize

#: Bytes of the longest context.
ORDER = 5
#: Nodes of the trie at each depth that tasks hold in memory (some 24 bytes a node); all others are joined.
MOST_NODES = 1_000_000
#: Words whose counts tasks hold in memory; the counts of all others are joined.
MOST_WORDS = 500_000
#: Distinct keys that a training task gathers before it hands them on.
MOST_KEYS = 4_000_000

GRAM, WORD = 0, 1


def byte_stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Each document as ``ORDER`` line feeds, its lower-cased words with a space between, and a line feed.

    Returns the bytes of all documents and where each begins, and the end.
    """
    length = words.end - words.start
    per_doc = np.diff(words.offsets)
    # A word is followed by one byte; a document without words has a line feed all the same.
    lead = (np.arange(words.n_docs) + 1) * ORDER + np.concatenate([[0], np.cumsum(per_doc == 0)])[:-1]
    begin = lead[words.doc] + np.cumsum(length + 1) - (length + 1)
    total = int((length + 1).sum()) + words.n_docs * ORDER + int((per_doc == 0).sum())
    out = np.full(total, 10, np.uint8)
    index = np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)
    inside = np.arange(int(length.sum())) + np.repeat(words.start - (np.cumsum(length) - length), length)
    out[index] = LOWER[words.data[inside]]
    more = np.ones(len(length), bool)
    more[words.offsets[1:][per_doc > 0] - 1] = False
    out[(begin + length)[more]] = 32
    sizes = np.bincount(words.doc, length + 1, words.n_docs).astype(np.int64) + ORDER + (per_doc == 0)
    return out, np.concatenate([[0], np.cumsum(sizes)])


def grams(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the documents with the ``ORDER`` bytes before it as one number, and where each document begins."""
    keys = stream[ORDER:].astype(np.uint64)
    for k in range(1, ORDER + 1):
        keys |= stream[ORDER - k : len(stream) - k].astype(np.uint64) << np.uint64(8 * k)
    # The line feeds before a text are not coded.
    coded = np.ones(len(stream), bool)
    coded[(bounds[:-1, None] + np.arange(ORDER)).ravel()] = False
    return keys[coded[ORDER:]], bounds - np.arange(len(bounds)) * ORDER


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams and of words (by hash) in a task's texts, and of its texts' ends."""
    parts: dict[int, list] = {GRAM: [], WORD: []}
    docs = size = 0

    def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
        found = parts[kind]
        return counted(np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found]))

    def rows() -> Iterator[pa.RecordBatch]:
        for kind in parts:
            keys, counts = merged(kind)
            for a in range(0, len(keys), 1 << 16):
                some = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys[some]), kind, np.int32)), pa.array(keys[some].view(np.int64)), pa.array(counts[some])],
                    names=["kind", "key", "n"],
                )
            parts[kind] = []

    for batch in batches:
        for words in chunks(batch.column(0)):
            docs += words.n_docs
            parts[GRAM].append(counted(grams(*byte_stream(words))[0]))
            parts[WORD].append(counted(words.hashes(lower=True)))
            size += len(parts[GRAM][-1][0]) + len(parts[WORD][-1][0])
            if size > MOST_KEYS:
                parts = {kind: [merged(kind)] for kind in parts}
                size = sum(len(p[0][0]) for p in parts.values())
                if size > MOST_KEYS // 2:
                    yield from rows()
                    size = 0
    if parts[GRAM]:
        yield from rows()
    if docs:
        yield pa.RecordBatch.from_arrays(
            [pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], names=["kind", "key", "n"]
        )


class Lookup:
    """A fixed map from numbers to float32 by open addressing, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << self.bits, np.float32)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 2**64 - 1]
            # Of keys that want the same free slot, one gets it.
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        slot = self._home(keys)
        at = self.keys[slot]
        found = at == keys
        left = np.flatnonzero(~found & (at != 2**64 - 1))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[left]]
            hit = at == keys[left]
            found[left[hit]] = True
            left = left[~hit & (at != 2**64 - 1)]
        return found, np.where(found, self.values[slot], np.float32(0))


@dataclass
class Trie:
    """Log10 code lengths of the most frequent nodes: by depth, of (context, byte) and of the escape from a context."""

    coded: list[Lookup]
    escapes: list[Lookup]
    coded_whole: list[bool]  #: whether there are no other nodes
    escapes_whole: list[bool]

    def score(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each byte after its context, and which of them take nodes that are not here; these are 0."""
        out, other = np.zeros(len(keys)), np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        for k in range(len(self.coded) - 1, -1, -1):
            found, value = self.coded[k].get(keys[left] & np.uint64((1 << 8 * (k + 1)) - 1))
            out[left] += value
            left = left[~found]
            if not self.coded_whole[k]:
                other[left] = True
                left = left[:0]
            if not len(left):
                break
            found, value = self.escapes[k].get(keys[left] >> np.uint64(8) & np.uint64((1 << 8 * k) - 1))
            out[left] += value
            if not self.escapes_whole[k]:
                other[left[~found]] = True
                left = left[found]
        out[left] -= np.log10(256)
        out[other] = 0
        return out, other


@dataclass
class Model:
    trie: Trie
    nodes: list[DataFrame]  #: by depth, all of the trie: key, code
    contexts: list[DataFrame]  #: context, escape
    head: Lookup  #: counts of the most frequent words
    words: DataFrame  #: counts of all others: key, n
    train_tokens: int
    vocabulary: int  #: distinct tokens, the end included
    ends: int


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count byte contexts and words of all texts; null is the empty text."""
    counts = (
        docs.select(F.col(text_col).alias("text")).mapInArrow(_count, "kind int, key long, n long")
        .groupBy("kind", "key").agg(F.sum("n").alias("n"))
    )
    counts = materialize(counts)
    bottom = counts.where(F.col("kind") == GRAM).select("key", "n")
    levels = [bottom]
    for k in range(ORDER - 1, -1, -1):
        level = levels[-1].select(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key"), "n")
        levels.append(materialize(level.groupBy("key").agg(F.sum("n").alias("n"))))
    trie, nodes, contexts = Trie([], [], [], []), [], []
    for k, level in enumerate(levels[::-1]):
        level = level.withColumn("context", F.shiftright("key", 8))
        if k:
            below = nodes[-1].select(F.col("key").alias("shorter"), F.col("p").alias("taken"))
            level = level.withColumn("shorter", F.col("key").bitwiseAND((1 << 8 * k) - 1)).join(below, "shorter").drop("shorter")
        else:
            level = level.withColumn("taken", F.lit(1 / 256))  # all bytes are alike below the empty context
        own = materialize(level.groupBy("context").agg(
            F.sum("n").alias("total"), F.count("*").cast("double").alias("q"), F.sum("taken").alias("taken")
        ))
        p = F.col("n") / (F.col("total") + F.col("q"))
        nodes.append(materialize(level.drop("taken").join(own.drop("taken"), "context").select("key", "n", p.alias("p"), F.log10(p).alias("code"))))
        escape = F.log10(F.col("q") / (F.col("total") + F.col("q"))) - F.log10(F.greatest(1 - F.col("taken"), F.lit(1e-12)))
        contexts.append(materialize(own.select("context", "total", escape.alias("escape"))))
        head, whole = _head(nodes[-1], "key", "n", "code")
        trie.coded.append(head)
        trie.coded_whole.append(whole)
        head, whole = _head(contexts[-1], "context", "total", "escape")
        trie.escapes.append(head)
        trie.escapes_whole.append(whole)
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = counts.where(F.col("kind") == 2).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    floor = count_floor(words, "n", MOST_WORDS)
    head = words.where(F.col("n") >= floor).toArrow()
    head = Lookup(head["key"].to_numpy().view(np.uint64), head["n"].to_numpy().astype(np.float32))
    return Model(trie, nodes, contexts, head, words.where(F.col("n") < floor), total["n"] + ends, total["v"] + (ends > 0), ends)


def _head(table: DataFrame, key: str, count: str, value: str) -> tuple[Lookup, bool]:
    """The most frequent rows in memory, and whether these are all."""
    floor = count_floor(table, count, MOST_NODES)
    found = table.where(F.col(count) >= floor).select(key, value).toArrow()
    head = Lookup(found[key].to_numpy().astype(np.uint64), found[value].to_numpy().astype(np.float32))
    return head, not table.where(F.col(count) < floor).limit(1).count()


def _joined_scores(keys: DataFrame, model: Model) -> DataFrame:
    """``key`` and ``value``, the log10 probability of its byte, by joins with all of the trie."""
    left, done = keys.select("key", F.lit(0.0).alias("value")), []
    for k in range(ORDER, -1, -1):
        nodes = model.nodes[k].select(F.col("key").alias("node"), "code")
        met = materialize(left.join(nodes, F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1) == F.col("node"), "left").drop("node"))
        done.append(met.where("code IS NOT NULL").select("key", (F.col("value") + F.col("code")).alias("value")))
        context = F.shiftright("key", 8).bitwiseAND((1 << 8 * k) - 1) == F.col("context")
        left = met.where("code IS NULL").join(model.contexts[k].select("context", "escape"), context, "left")
        left = left.select("key", (F.col("value") + F.coalesce("escape", F.lit(0.0))).alias("value"))
    done.append(left.select("key", (F.col("value") - float(np.log10(256))).alias("value")))
    return reduce(DataFrame.union, done)


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` is the log10 probability of the words under their counts, ``score`` that of the text under
    the trie.  A null or empty text is its end alone.  Without training texts ``score`` takes all bytes as alike.
    Other columns are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.trie, model.head))
    bottom = model.train_tokens + 0.1 * (model.vocabulary + 1)
    # A word is unknown for good if all counted words are in the head.
    rest = small(materialize(model.words))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, head = shared.value
        for batch in batches:
            for words in chunks(batch.column(1)):
                keys, bounds = grams(*byte_stream(words))
                # Every document has an end, so none is empty.
                logs, other = trie.score(keys)
                total, other = np.add.reduceat(logs, bounds[:-1]), np.flatnonzero(other)
                among = np.searchsorted(other, bounds)
                hashes = words.hashes(lower=True)
                found, n = head.get(hashes)
                logs = np.where(found, np.log10((n.astype(float) + 0.1) / bottom), 0.0)
                tail = np.flatnonzero(~found)
                where = np.searchsorted(tail, words.offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(words.first, words.n_docs), pa.array(total), pa.array(np.diff(words.offsets)),
                        pa.array(np.bincount(words.doc, found, words.n_docs).astype(np.int64)),
                        pa.array(np.bincount(words.doc, logs, words.n_docs)),
                        pa.LargeListArray.from_arrays(where, pa.array(hashes[tail].view(np.int64))).cast(pa.list_(pa.int64())),
                        pa.LargeListArray.from_arrays(among, pa.array(keys[other].view(np.int64))).cast(pa.list_(pa.int64())),
                    ],
                    names=["id", "score", "n", "known", "base", "tail", "grams"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        score, f"id {kind}, score double, n long, known long, base double, tail array<long>, grams array<long>"
    )
    # Written with a number each: rows may share an id.
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    tail = rows.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    count = F.coalesce(F.col("n"), F.lit(0))
    tail = tail.join(rest, "key", "left").groupBy("row").agg(
        F.sum(F.col("times") * _log(count, bottom)).alias("tail_base"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("tail_known")
    )
    joined = rows.drop("tail", "grams").join(tail, "row", "left").withColumn("more", F.lit(0.0))
    if not all(model.trie.coded_whole + model.trie.escapes_whole):
        unknown = materialize(rows.select("row", F.explode("grams").alias("key")).groupBy("key", "row").agg(F.count("*").alias("times")))
        values = materialize(_joined_scores(unknown.select("key").distinct(), model))
        more = unknown.join(values, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
        joined = joined.drop("more").join(more, "row", "left")
    return joined.select(
        F.col("id").alias("doc_id"), (F.col("n") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + int(model.ends > 0)).alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) + _log(F.lit(model.ends), bottom)).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def _log(count: Column, bottom: float) -> Column:
    return F.log10((count + F.lit(0.1)) / F.lit(float(bottom)))
