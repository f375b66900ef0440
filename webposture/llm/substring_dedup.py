"""Repeated word sequences by FM-indexes over shards of the text.

Every window of ``n`` words has a key that depends on its words alone: the least hash of the five-word runs in it.
Neighbouring windows with the same key make a string, and all strings with the same key meet in one shard, so
every occurrence of a window is found in the shard of its key and no document visits other shards.  A shard's index is
built from its distinct strings: a Burrows-Wheeler transform of their words (suffixes in the order of
their first 16 words), a wavelet matrix over it with bit vectors and rank directories, and the smallest document
of each suffix.  The strings are then streamed against it: backward search extends matches to the left word by
word, up to ``n``, until the interval of suffixes holds the window alone; what reaches ``n`` is reported with the
smallest document in its interval.

Keys that occur in one document only are left out beforehand, by a bit array of fixed size: where it is full it
lets too much through, never too little.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.text import Words, chunks, counted, mix, rolling, split
from webposture.session import materialize

WINDOW = 13
#: Words of the runs whose least hash is a window's key.
RUN = 5
#: Bits of the array that marks repeated keys: 16 MB.
MARK_BITS = 27
#: Windows in a string at most.
STRING_WINDOWS = 32
#: A key is hot if it occurs in so many documents, or in more than a hundred thousandth of all occurrences, so there
#: are a hundred thousand of them at most.  Windows with a hot key go to shards by a hash of all their words.
HOT_DOCS = 10_000
HOT_SHARE = 100_000
#: Words that are indexed at once; keys are never split.
SHARD_WORDS = 250_000
#: Words by which suffixes are put in order; backward search is right up to that length.
CONTEXT = 16
#: The place of a null id: behind all others.
LAST = 2**63 - 1


def _minima(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    out, width = values, 1
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out


def window_keys(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of ``n`` words that lie within one document start, and their 40-bit keys."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    run = min(RUN, n)
    keys = _minima(rolling(hashes, run), n - run + 1) >> np.uint64(24)
    start = np.arange(len(keys))
    inside = words.offsets[1:][words.doc[: len(keys)]] - start >= n
    return start[inside], keys[inside]


def _count(n: int):
    """An Arrow function over (id, text): per key the smallest and greatest document and the number of documents."""

    def merged(parts: list) -> tuple[np.ndarray, ...]:
        key, low, high, docs = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        key, low, high, docs = key[order], low[order], high[order], docs[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.add.reduceat(docs, first)

    def rows(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(found[0]), 1 << 16):
            cut = [x[a : a + (1 << 16)] for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(cut[0].view(np.int64)), *map(pa.array, cut[1:])], names=["key", "low", "high", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for words in chunks(batch.column(2)):
                start, keys = window_keys(words, words.hashes(), n)
                if not len(keys):
                    continue
                doc = words.doc[start]
                # Neighbouring windows mostly share their key.
                fresh = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]
                keys, doc = keys[fresh], doc[fresh]
                pair = counted(keys << np.uint64(24) | doc.astype(np.uint64))[0] if words.n_docs < 1 << 24 else None
                if pair is not None:
                    keys, doc = pair >> np.uint64(24), (pair & np.uint64((1 << 24) - 1)).astype(np.int64)
                of = ids[words.first + doc]
                parts.append((keys, of, of, np.ones(len(keys), np.int64)))
                size += len(keys)
                if size > 2_000_000:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if size > 1_000_000:
                        yield from rows(parts[0])
                        parts, size = [], 0
        if parts:
            yield from rows(merged(parts))

    return count


_bases: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if base not in _bases or len(_bases[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _bases[base] = tuple(both)
    return _bases[base]


def _content(hashes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the words from ``start`` to before ``end``."""
    power, inverse = _powers(base, len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def strings(words: Words, n: int, marked: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with the same marked key: key, first word, windows, two content hashes."""
    hashes = words.hashes()
    start, keys = window_keys(words, hashes, n)
    bit = keys & np.uint64((1 << MARK_BITS) - 1)
    some = (marked[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
    start, keys = start[some], keys[some]
    if not len(start):
        return {k: np.empty(0, np.int64) for k in ("key", "first", "windows", "s1", "s2")}
    alone = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
    doc = words.doc[start]
    fresh = np.r_[True, (start[1:] != start[:-1] + 1) | (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | alone[1:]]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
    fresh |= (np.arange(len(fresh)) - begin) % STRING_WINDOWS == 0
    at = np.flatnonzero(fresh)
    first, windows = start[at], np.diff(at, append=len(start))
    end = first + windows + n - 1
    s1, s2 = (_content(hashes, first, end, base) for base in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
    key = np.where(alone[at], s1 >> np.uint64(24), keys[at])
    return {"key": key.view(np.int64), "first": first, "windows": windows, "s1": s1.view(np.int64), "s2": s2.view(np.int64)}


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of bytes."""
    length = end - start
    bounds = np.concatenate([[0], np.cumsum(length)])
    flat = data[np.repeat(start - bounds[:-1], length) + np.arange(bounds[-1])]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())])
    return column.cast(pa.binary())


def _occurrences(n: int, shared):
    """An Arrow function over (id, row, text): every string with its document and place."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for words in chunks(batch.column(2)):
                found = strings(words, n, *shared.value)
                doc = words.doc[found["first"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["s1"]), pa.array(found["s2"]), pa.array(ids[words.first + doc]), pa.array(rows[words.first + doc]),
                     pa.array((found["first"] - words.offsets[doc]).astype(np.int32))],
                    names=["s1", "s2", "id", "row", "first"],
                )

    return find


_DISTINCT = "key long, s1 long, s2 long, low long, high long, text binary"


def _distinct(n: int, shared):
    """An Arrow function over (id, row, text): a task's distinct strings with their smallest and greatest document."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        s1, s2 = table["s1"].to_numpy(), table["s2"].to_numpy()
        order = np.lexsort((s2, s1))
        first = np.flatnonzero(np.r_[True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])])
        low = np.minimum.reduceat(table["low"].to_numpy()[order], first)
        high = np.maximum.reduceat(table["high"].to_numpy()[order], first)
        out = table.take(pa.array(order[first]))
        return out.set_column(3, "low", pa.array(low)).set_column(4, "high", pa.array(high))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for words in chunks(batch.column(2)):
                found = strings(words, n, *shared.value)
                if not len(found["first"]):
                    continue
                of = pa.array(ids[words.first + words.doc[found["first"]]])
                last = found["first"] + found["windows"] + n - 2
                text = _cut(words.data, words.start[found["first"]], words.end[last])
                parts.append(merged([pa.table({"key": found["key"], "s1": found["s1"], "s2": found["s2"], "low": of, "high": of, "text": text})]))
                size += parts[-1].nbytes
                if size > 48 << 20:
                    yield from merged(parts).to_batches(max_chunksize=1 << 15)
                    parts, size = [], 0
        if parts:
            yield from merged(parts).to_batches(max_chunksize=1 << 15)

    return find


class BitVector:
    """Bits in 64-bit words with the number of ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(np.pad(bits, (0, 64 + -len(bits) % 64)), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """Backward search over a sequence of symbols, right for patterns of up to ``CONTEXT`` symbols."""

    def __init__(self, text: np.ndarray) -> None:
        """``text``: symbols from 0 on; 0 ends each string."""
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < CONTEXT:  # order by the first 2, 4, 8, 16 symbols
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1]
            width *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        transform = text[self.suffixes - 1]
        sizes = np.bincount(text)
        self.first = np.concatenate([[0], np.cumsum(sizes)])  # of suffixes by their first symbol
        self.levels, self.zeros = [], []
        self.bits = max(1, int(len(sizes) - 1).bit_length())
        values = transform
        for k in range(self.bits - 1, -1, -1):
            bit = values >> k & 1
            self.levels.append(BitVector(bit.astype(np.uint8)))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = values[np.argsort(bit, kind="stable")]
        symbols = np.arange(len(sizes))
        self.base = self._down(symbols, np.zeros(len(sizes), np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where positions of the transform lead in the wavelet matrix, following the symbols' bits."""
        for level, (vector, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = vector.rank(at)
            at = np.where(symbols >> (self.bits - 1 - level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that have each symbol before what those from ``low`` to ``high`` begin with."""
        shift = self.first[symbols] - self.base[symbols]
        return self._down(symbols, low) + shift, self._down(symbols, high) + shift


def repeats(text: np.ndarray, owner: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each window of ``n`` symbols ending before ``ends``: the smallest owner of its occurrences in the text.

    ``owner``: the document of each position.  A window that occurs once gets its own.
    """
    index = FMIndex(text)
    by_suffix = np.append(owner[index.suffixes], LAST)
    out = owner[ends - n]
    left = np.arange(len(ends))
    symbols = text[ends - 1]
    low, high = index.first[symbols], index.first[symbols + 1]
    for back in range(2, n + 1):
        more = high - low > 1  # else the window itself is all there is
        left, low, high = left[more], low[more], high[more]
        low, high = index.extend(text[ends[left] - back], low, high)
    if len(left):
        # Intervals of patterns of the same length are the same or apart.
        begin, first, inverse = np.unique(low, return_index=True, return_inverse=True)
        edges = np.column_stack([begin, high[first]]).ravel()
        out[left] = np.minimum.reduceat(by_suffix, edges)[::2][inverse]
    return out


def _search(n: int):
    """An Arrow function over distinct strings in the order of their keys: the windows' smallest documents."""

    def shard(parts: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(parts)
        s1, s2 = table["s1"].to_numpy(), table["s2"].to_numpy()
        order = np.lexsort((s2, s1))
        first = np.flatnonzero(np.r_[True, (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1])])
        low = np.minimum.reduceat(table["low"].to_numpy()[order], first)
        high = np.maximum.reduceat(table["high"].to_numpy()[order], first)
        rows = order[first]
        column = table["text"].take(pa.array(rows)).combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(column.buffers()[1], np.int64)[: len(rows) + 1]
        words = split(np.frombuffer(column.buffers()[2], np.uint8)[: bounds[-1]], bounds)
        # Symbols from 1 on, and a 0 behind each string.
        symbol = np.unique(words.hashes(), return_inverse=True)[1] + 1
        size = np.diff(words.offsets)
        text = np.zeros(len(symbol) + len(rows), np.int64)
        text[np.arange(len(symbol)) + words.doc] = symbol
        string = np.repeat(np.arange(len(rows)), size + 1)
        begin = words.offsets[:-1] + np.arange(len(rows))
        windows = size - n + 1
        bounds = np.concatenate([[0], np.cumsum(windows)])
        ends = np.arange(bounds[-1]) + np.repeat(begin + n - bounds[:-1], windows)
        least = repeats(text, low[string], ends, n)
        useful = np.minimum.reduceat(least, bounds[:-1]) < high
        where = np.repeat(useful, windows)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(windows[useful])]), pa.array(least[where]))
        return pa.RecordBatch.from_arrays(
            [pa.array(s1[rows][useful]), pa.array(s2[rows][useful]), lists.cast(pa.list_(pa.int64()))], names=["s1", "s2", "least"]
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            keys = table["key"].to_numpy()
            at = 0
            # A shard may end where the key changes; a word takes some 6 bytes.
            sizes = np.cumsum(pc.binary_length(table["text"]).to_numpy()) // 6
            change = np.flatnonzero(np.r_[not parts or parts[-1]["key"][-1].as_py() != keys[0], keys[1:] != keys[:-1]])
            for c in change:
                done = sizes[c - 1] - (sizes[at - 1] if at else 0) if c else 0
                if size + done >= SHARD_WORDS:
                    yield shard([*parts, table.slice(at, c - at)])
                    parts, size, at = [], 0, int(c)
            parts.append(table.slice(at))
            size += int(sizes[-1] - (sizes[at - 1] if at else 0))
        if parts and sum(map(len, parts)):
            yield shard(parts)

    return search


def _trim(n: int):
    """An Arrow function over documents and their repeated windows: what is left of the words."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2)
            for words in chunks(batch.column(1)):
                gone = np.zeros(len(words.start) + n + STRING_WINDOWS, np.int32)
                for d in range(words.n_docs):
                    runs = found[words.first + d].as_py()
                    if not runs:
                        continue
                    first = np.array([r["first"] for r in runs])
                    mask = np.array([r["mask"] for r in runs], np.int64)
                    bits = mask[:, None] >> np.arange(STRING_WINDOWS) & 1
                    at = words.offsets[d] + (first[:, None] + np.arange(STRING_WINDOWS))[bits.astype(bool)]
                    # Marks where covered stretches begin and end; the document's own windows end within it.
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + n, -1)
                kept = np.cumsum(gone)[: len(words.start)] == 0
                hashed, removed = [], []
                for d in range(words.n_docs):
                    a, b = words.offsets[d], words.offsets[d + 1]
                    at = np.flatnonzero(kept[a:b]) + a
                    removed.append(int(b - a) - len(at))
                    hashed.append(hashlib.sha256(_joined(words, at)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.first, words.n_docs), pa.array(np.diff(words.offsets)), pa.array(removed, pa.int64()), pa.array(hashed)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"],
                )

    return trim


def _joined(words: Words, at: np.ndarray) -> bytes:
    """Some words with one space between."""
    if not len(at):
        return b""
    start, length = words.start[at], words.end[at] - words.start[at]
    bounds = np.cumsum(length + 1)
    out = np.full(int(bounds[-1]), 32, np.uint8)
    to = np.arange(int(length.sum())) + np.repeat(np.arange(len(at)), length)
    out[to] = words.data[np.repeat(start - (bounds - length - 1), length) + to]
    return out[:-1].tobytes()


def repeated_windows(texts: DataFrame, n: int) -> DataFrame:
    """id, row, runs: where documents (id, row, text) hold windows that occur in a document with a smaller id.

    ``runs`` is a list of (first word, mask): bit k says that the window at word first + k is such a one.
    """
    spark = texts.sparkSession
    keys = texts.mapInArrow(_count(n), "key long, low long, high long, docs long").groupBy("key")
    keys = materialize(keys.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("docs").alias("docs")).where("low < high").select("key", "docs"))
    total = keys.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"]
    hot = keys.where(F.col("docs") > max(HOT_DOCS, total // HOT_SHARE)).select("key").toArrow()["key"].to_numpy()
    # The bit array has the same size for any number of keys.
    bit = F.col("key").bitwiseAND((1 << MARK_BITS) - 1)
    bits = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")
    ).toArrow()
    marked = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    marked[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast((marked, np.sort(hot.astype(np.uint64))))
    least = (
        texts.mapInArrow(_distinct(n, shared), _DISTINCT).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_search(n), "s1 long, s2 long, least array<long>")
    )
    least = materialize(least)
    occurrences = texts.mapInArrow(_occurrences(n, shared), "s1 long, s2 long, id long, row long, first int")
    mask = F.aggregate(
        F.sequence(F.lit(0), F.size("least") - 1), F.lit(0).cast("long"),
        lambda m, k: m.bitwiseOR(F.when(F.get("least", k) < F.col("id"), F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(0)),
    )
    runs = occurrences.join(least, ["s1", "s2"]).select("id", "row", "first", mask.alias("mask")).where("mask <> 0")
    return runs.groupBy("id", "row").agg(F.collect_list(F.struct("first", "mask")).alias("runs"))


def drop_repeated_windows(docs: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Words that lie in a window of ``n`` (at most 16) words which also occurs in a document with a smaller id are
    removed; windows are judged on the input.  ``kept_sha256`` is that of the kept words, joined by one space.  A null
    or empty text has no words.  Null ids come behind all others and don't remove each other's words; rows that
    repeat an id don't either.  Other columns are not read.
    """
    if not 1 <= n <= CONTEXT:
        raise ValueError(f"windows have 1 to {CONTEXT} words")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(LAST)), "row": F.xxhash64("text")})
    runs = repeated_windows(rows.select("id", "row", "text"), n).select(F.col("id").alias("of"), F.col("row").alias("at"), "runs")
    joined = rows.join(runs, (F.col("id") == F.col("of")) & (F.col("row") == F.col("at")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_trim(n), "doc_id long, n_words long, n_removed long, kept_sha256 string")
