"""Collocations: frequent phrases whose parts meet more often than by chance.

The words that occur often enough are numbered by frequency, so the pairs of a text fall into square tiles of two ranges of
numbers.  A task counts a tile that has many of its pairs in a dense array by direct address and all other tiles together as
sorted coordinates; Spark adds up the tasks' counts.  Frequent pairs are numbered by frequency in turn, and two that overlap
are a pair again, a phrase of three words, and so on.  A phrase can only be frequent if its beginning and its end are.

Numbers below ``HEAD`` are held in memory by the tasks.  Words and pairs beyond that are known by a hash instead and always
counted as sorted coordinates, so memory is bounded and no phrase is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.text import LOWER, Words, chunks, mix
from webposture.operators.ordering import with_rank
from webposture.session import materialize

LONGEST, LEAST, TOP = 5, 100, 2000
#: Numbers that tasks hold in memory, for each length of phrase: two arrays of 8 MB.
HEAD = 1_000_000
#: Numbers on a side of a tile, and how many of a buffer's pairs make it a dense one.
TILE, DENSE = 1024, 1024 * 1024 // 8
#: Pairs that a task counts at once, and different words that it gathers.
BUFFER, WORDS = 4_000_000, 400_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a word, and those of them that end a piece.
_PIECE = np.zeros(256, bool)
_PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
_BREAKS = _PIECE.copy()
_BREAKS[[9, 32]] = True
#: Lower case, and every byte that ends a word as a space.
_FOLD = LOWER.copy()
_FOLD[_BREAKS] = 32
#: Hashes that stand for numbers have this bit, so that they differ from numbers.
_HASHED = np.int64(1 << 62)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Of (lang, text): lower-cased words, each one's piece, a hash of each with its document's language, its language's number, all names."""
    lang = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
    names, codes = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
    salt = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names], np.uint64)
    for words in chunks(batch.column(1), _BREAKS):
        piece = np.searchsorted(np.flatnonzero(_PIECE[words.data]), words.start)
        words.data = _FOLD[words.data]
        code = codes[words.first : words.first + words.n_docs][words.doc]
        yield words, piece, mix(words.hashes() ^ salt[code]), code, names


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function over (lang, text): lang, word, hash, n; and lang, null, null, n with the number of all words."""
    known, count, place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    texts: list[str] = []
    langs: list[str] = []
    total: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([langs[p] for p in place], pa.string()), pa.array([texts[p] for p in place], pa.string()), pa.array(known.view(np.int64)), pa.array(count)],
            names=["lang", "word", "hash", "n"],
        )

    for batch in batches:
        for words, _, hashes, code, names in _runs(batch):
            for c, n in zip(*np.unique(code, return_counts=True)):
                total[names[c]] = total.get(names[c], 0) + int(n)
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            at = np.searchsorted(known, found)
            old = np.zeros(len(found), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == found
            count[at[old]] += n[old]
            texts_from = len(texts)
            texts += words.strings(first[~old])
            langs += [names[c] for c in code[first[~old]]]
            known = np.concatenate([known, found[~old]])
            order = np.argsort(known, kind="stable")
            known, count = known[order], np.concatenate([count, n[~old]])[order]
            place = np.concatenate([place, np.arange(texts_from, len(texts))])[order]
            if len(known) > WORDS:
                yield out()
                known, count, place, texts, langs = known[:0], count[:0], place[:0], [], []
    yield out()
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
        names=["lang", "word", "hash", "n"],
    )


class Numbers:
    """Keys and the numbers they stand for; ``whole`` if there are no others."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray, whole: bool):
        order = np.argsort(keys)
        self.keys, self.numbers, self.whole = keys[order], numbers[order], whole

    def of(self, keys: np.ndarray, hashed: Callable[[], np.ndarray]) -> np.ndarray:
        """The number of each key; of those beyond the numbers -1 if there are none that count, else their hash."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            found = self.keys[at] == keys
            out = np.where(found, self.numbers[at], -1)
        else:
            out = np.full(len(keys), -1, np.int64)
        return out if self.whole else np.where(out >= 0, out, hashed())


def _hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = mix(mix(a.astype(np.uint64) * _STEP) + b.astype(np.uint64))
    return (both >> np.uint64(2)).view(np.int64) | _HASHED


def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair as one number."""
    return np.where((a < _HASHED) & (b < _HASHED), a << 31 | b, _hashed(a, b))


def _encode(numbers, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An Arrow function over (lang, text): the numbers of a document's words, -1 for any run of others and ends of pieces."""
    numbers = numbers.value
    kind = np.int32 if numbers.whole else np.int64
    for batch in batches:
        for words, piece, hashes, _, _ in _runs(batch):
            ids = numbers.of(hashes, lambda: (hashes >> np.uint64(2)).view(np.int64) | _HASHED)
            # A place more after the last word of every piece; documents end pieces.
            last = np.ones(len(ids), bool)
            last[:-1] = (piece[1:] != piece[:-1]) | (words.doc[1:] != words.doc[:-1])
            ends = np.cumsum(1 + last)
            flat = np.full(ends[-1] if len(ends) else 0, -1, np.int64)
            flat[ends - 1 - last] = ids
            keep = np.ones(len(flat), bool)
            keep[1:] = (flat[1:] >= 0) | (flat[:-1] >= 0)
            bounds = np.concatenate([[0], ends])[words.offsets]
            bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
            data = flat[keep].astype(kind)
            yield pa.RecordBatch.from_arrays(
                [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * data.itemsize), pa.py_buffer(data)]).cast(pa.binary())],
                names=["ids"],
            )


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs and how often each occurs: a, b, n."""
    known = (a < _HASHED) & (b < _HASHED)
    out = []
    if not known.all():
        x, y = a[~known], b[~known]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        out.append((x[start], y[start], np.diff(start, append=len(x))))
        a, b = a[known], b[known]
    if len(a):
        side = max(int(a.max()), int(b.max())) // TILE + 1
        tile = a // TILE * side + b // TILE
        cell = a % TILE * TILE + b % TILE
        load = np.bincount(tile, minlength=1) if side < 2048 else None
        dense = np.flatnonzero(load >= DENSE) if load is not None else []
        sparse = np.ones(len(a), bool)
        for t in dense:
            inside = tile == t
            sparse &= ~inside
            table = np.bincount(cell[inside], minlength=TILE * TILE)
            some = np.flatnonzero(table)
            out.append((t // side * TILE + some // TILE, t % side * TILE + some % TILE, table[some]))
        pair, n = np.unique(a[sparse] << 31 | b[sparse], return_counts=True)
        out.append((pair >> 31, pair & (1 << 31) - 1, n))
    empty = np.empty(0, np.int64)
    return tuple(np.concatenate([empty, *[part[k] for part in out]]) for k in range(3))


def _pairs(levels: list, whole: bool):
    """An Arrow function over encoded documents: a, b, n for the overlapping pairs of frequent phrases of ``len(levels) + 1`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.int32 if whole else np.int64
        left, right, held = [], [], 0
        for batch in batches:
            for a, b in _adjacent(batch.column(0), kind, [n.value for n in levels]):
                left.append(a)
                right.append(b)
                held += len(a)
                if held >= BUFFER:
                    yield _batch(*count_pairs(np.concatenate(left), np.concatenate(right)))
                    left, right, held = [], [], 0
        if held:
            yield _batch(*count_pairs(np.concatenate(left), np.concatenate(right)))

    return count


def _adjacent(column: pa.Array, kind: type, levels: list[Numbers]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What follows each other in the documents of a column, some megabytes at a time."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, at = column.buffers()[2], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (8 << 20), "right")) - 1)
        size = int(bounds[to] - bounds[at])
        if size:
            unit = np.frombuffer(data, kind, size // kind().itemsize, int(bounds[at])).astype(np.int64)
            for numbers in levels:
                unit = _next(unit, numbers)
            i = np.flatnonzero((unit[:-1] >= 0) & (unit[1:] >= 0))
            if len(i):
                yield unit[i], unit[i + 1]
        at = to


def _next(unit: np.ndarray, numbers: Numbers) -> np.ndarray:
    """The numbers of phrases that are one word longer."""
    i = np.flatnonzero((unit[:-1] >= 0) & (unit[1:] >= 0))
    a, b = unit[i], unit[i + 1]
    out = np.full(max(len(unit) - 1, 0), -1, np.int64)
    out[i] = numbers.of(_key(a, b), lambda: _hashed(a, b))
    return out


def _batch(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])


def _head(numbered: DataFrame, keys: Callable[[pa.Table], np.ndarray], head: int):
    """The numbers below ``head`` for all tasks."""
    table = numbered.where(F.col("rank") < head).toArrow()
    whole = numbered.where(F.col("rank") >= head).isEmpty()
    return numbered.sparkSession.sparkContext.broadcast(Numbers(keys(table), table["rank"].to_numpy(), whole)), whole


def phrases(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", head: int = HEAD,
) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """All phrases of 1 to ``longest`` words that occur ``least`` times or more.

    Returns a table of lang and n (all its words); one of lang, phrase, size, f, id; and for each size from 2 a table of a, b, n,
    id, where a and b are the ids of the phrase without its last and without its first word.
    """
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counted = texts.mapInArrow(count_words, "lang string, word string, hash long, n long").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))
    counted = materialize(counted.where(F.col("hash").isNull() | (F.col("n") >= least)))
    totals = counted.where("hash IS NULL").select("lang", "n")
    words = with_rank(counted.where("hash IS NOT NULL").withColumn("down", -F.col("n")), [], ["down", "lang", "word"])
    hashed = F.shiftrightunsigned("hash", 2).bitwiseOR(F.lit(1 << 62))
    words = materialize(words.select("lang", "word", "hash", "n", "rank", F.when(F.col("rank") < head, F.col("rank")).otherwise(hashed).alias("id")))
    numbers, whole = _head(words.select("hash", "rank"), lambda t: t["hash"].to_numpy().view(np.uint64), head)
    encoded = materialize(texts.mapInArrow(lambda batches: _encode(numbers, batches), "ids binary"))
    known = [words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), F.col("n").alias("f"), "id", F.col("word").alias("last"))]
    tables: list[DataFrame] = []
    levels: list = []
    for size in range(2, longest + 1):
        pairs = encoded.mapInArrow(_pairs(list(levels), whole), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        ranked = with_rank(pairs.withColumn("down", -F.col("n")), [], ["down", "a", "b"]).select("a", "b", "n", "rank")

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, rank = (batch.column(k).to_numpy() for k in (0, 1, 3))
                yield batch.append_column("id", pa.array(np.where(rank < head, rank, _hashed(a, b))))

        ranked = materialize(ranked.mapInArrow(name, "a long, b long, n long, rank long, id long"))
        first, second = known[-1].alias("x"), known[-1].alias("y")
        joined = ranked.join(first, F.col("a") == F.col("x.id")).join(second, F.col("b") == F.col("y.id"))
        named = materialize(joined.select(
            F.col("x.lang").alias("lang"), F.concat_ws(" ", "x.phrase", "y.last").alias("phrase"), F.lit(size).alias("size"),
            F.col("n").alias("f"), ranked["id"].alias("id"), F.col("y.last").alias("last"),
        ))
        known.append(named)
        tables.append(ranked)
        if size < longest:
            numbers, _ = _head(ranked.select("a", "b", "rank"), lambda t: _key(t["a"].to_numpy(), t["b"].to_numpy()), head)
            levels.append(numbers)
    return totals, reduce(DataFrame.unionByName, known).drop("last"), tables


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = 100, top: int | None = TOP,
    text_col: str = "text", lang_col: str = "lang", head: int = HEAD,
) -> DataFrame:
    """The ``top`` phrases (all, if None) of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs.  A phrase is 2 to
    ``longest`` words in a row of a piece that occur ``least`` times or more, overlaps included (a).  Cut in two, with l and r occurrences of
    the parts, it scores floor(1000 * a * n / (l * r)), n being all words of the language; the cut with the lowest score counts, the first of
    equal ones.  A phrase is dropped if a longer one around it occurs ``percent`` % as often or more.  It is enough to look at those one word longer,
    since what lies between a phrase and a longer one is no rarer than the longer one.  Order: score, then a, falling, then phrase by bytes.

    A null language is ``und``; null and empty texts, and empty tables, have no phrases.  Repeated rows count as often as they occur.
    Other columns are not read.
    """
    totals, known, tables = phrases(docs, longest, least, text_col, lang_col, head)
    known = materialize(known)
    inside = []
    for size, table in enumerate(tables[1:], 2):
        inside += [table.select(F.lit(size).alias("size"), F.col(side).alias("id"), F.col("n").alias("around")) for side in ("a", "b")]
    found = known.where("size > 1")
    if inside:
        around = reduce(DataFrame.unionByName, inside).groupBy("size", "id").agg(F.max("around").alias("around"))
        found = found.join(around, ["size", "id"], "left").where(F.col("around").isNull() | (100 * F.col("around") < percent * F.col("f")))
    word = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(word, F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice(word, F.col("cut") + 1, F.col("size") - F.col("cut")), " ").alias("right"),
    )
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(totals, "lang")
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(1000 * {wide.format('a')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})")
    best = cuts.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", (-F.col("best.score")).alias("down"), (-F.col("a")).alias("rarer"))
    ranked = with_rank(best, ["lang"], ["down", "rarer", "phrase"])
    if top is not None:
        ranked = ranked.where(F.col("rank") < top)
    return ranked.select("lang", (F.col("rank") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
