"""Similar lines by an exact set-similarity join.

A line is the set of its lower-cased words.  The words are brought into one order, rare ones first.  Two sets
of sizes x <= y with a Jaccard similarity of at least t share at least ceil(t * y) words, so they share one among
the first y - ceil(t * y) + 1 words of the one and as many of the other (prefix filter).  Sets that post the same word
make up its list, sorted by size.  Pairs of a list are dropped if their sizes differ too much (length filter), if too
few words are left from the common one on (positional filter; the first word that both share passes), or if
the parities of their words by 128 hash classes differ in more places than the sets may.  What is left is verified on the sets.

Of a line only the earliest similar one is asked for.  So a list with many pairs, or with many sets, makes no pairs: its sets are
dealt into blocks, and a task that has two blocks with all words compares them and returns one row for each set at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.tables import count_floor
from webposture.llm.text import Words, chunks, counted, mix
from webposture.session import materialize

#: Words whose counts decide on the order; all others are rarer and come first, by their hashes.
MOST_WORDS = 300_000
#: First bits of a hash by which the words of the order are looked up.
CELL_BITS = 20
#: Words in this many lines or more are hot: their lists are also spread by size, and always dealt into blocks.
HOT = 100_000
#: Sets of a block of a list.
BLOCK = 2048
#: Words of all sets of a block.
BLOCK_WORDS = 2 << 20
#: A list with more pairs than this for each of its sets is compared in blocks.
PAIRS = 4
#: Bits of the arrays that mark words and sets: 16 MB, whatever their number.  What they let through in error is
#: joined away.
MARK_BITS = 27


def line_sets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty lines as sets of words: word hashes one after the other, bounds, document, line number from 0."""
    hashes = words.keys(lower=True)
    if not len(hashes):
        return hashes, np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    feeds = np.flatnonzero(words.data == 10)
    before = np.cumsum(np.bincount(np.searchsorted(words.start, feeds), minlength=len(hashes))[: len(hashes)])
    number = before - np.searchsorted(feeds, words.bounds[:-1])[words.doc]  # line feeds of the document before the word
    line = np.cumsum(np.r_[False, (number[1:] != number[:-1]) | (words.doc[1:] != words.doc[:-1])])
    # One sort by line and the hash's first bits; by the whole hash only if two words differ behind them.
    kept = np.uint64(max(1, int(line[-1]).bit_length()))
    short = line.astype(np.uint64) << (np.uint64(64) - kept) | hashes >> kept
    order = np.argsort(short)
    short, by_short = short[order], hashes[order]
    if ((short[1:] == short[:-1]) & (by_short[1:] != by_short[:-1])).any():
        order = np.lexsort((hashes, line))
    hashes, at = hashes[order], line[order]
    fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (at[1:] != at[:-1])]
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    bounds = np.searchsorted(at[fresh], np.arange(line[-1] + 2))
    return hashes[fresh], bounds, words.doc[first], number[first]


def _identity(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    return mix(np.add.reduceat(hashes, bounds[:-1]) ^ np.diff(bounds).astype(np.uint64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in batches:
        for words in chunks(batch.column(1)):
            parts.append(counted(words.keys(lower=True)))
            size += len(parts[-1][0])
            if size > 4_000_000:
                yield _counts(parts)
                parts, size = [], 0
    if parts:
        yield _counts(parts)


def _counts(parts: list) -> pa.RecordBatch:
    keys, counts = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["word", "n"])


def _read(percent: int, shared):
    """An Arrow function over (id, text): every non-empty line with its set.

    What is posted stands with the first line of a set within a run only: parities of the words, and the prefix in its order as
    32-bit keys.  Words that share a key are taken for one here, which only adds candidates.  Key 0 is a word that occurs once,
    so that no two lines have it in common.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, cells, rank, by_rank, twice = shared.value
        for batch in batches:
            for words in chunks(batch.column(1)):
                hashes, bounds, doc, number = line_sets(words)
                if not len(doc):
                    continue
                sets, size = _identity(hashes, bounds), np.diff(bounds)
                n_lines = len(sets)
                first = np.sort(np.unique(sets, return_index=True)[1])
                is_first = np.zeros(n_lines, bool)
                is_first[first] = True
                hashes, size = hashes[np.repeat(is_first, size)], size[first]
                begin = np.cumsum(size) - size
                parity = _parities(hashes, begin)
                # Rare words by their keys, then the head's by their ranks: 33 bits, behind them whether it occurs again, before them the line.
                value = _keys(hashes)
                if len(head):
                    at = np.minimum(_place(head, cells, hashes), len(head) - 1)
                    value = np.where(head[at] == hashes, np.uint64(1 << 32) + rank[at], value)
                line = np.repeat(np.arange(len(size)), size)
                order = np.sort(line.astype(np.uint64) << np.uint64(34) | value << np.uint64(1) | _is_marked(twice, hashes))
                position = np.arange(len(hashes)) - begin[line]
                taken = size - -(-size * percent // 100) + 1
                order = order[position < taken[line]]
                value = order >> np.uint64(1) & np.uint64((1 << 33) - 1)
                if len(head):
                    value = np.where(value >> np.uint64(32), by_rank[(value & np.uint64(0xFFFFFFFF)) % np.uint64(len(head))], value)
                keys = np.where(order & np.uint64(1), value, 0).astype("<u4")
                length, left, right = np.zeros((3, n_lines), np.int64)
                sizes = np.zeros(n_lines, np.int32)
                length[first] = 4 * taken
                prefix = pa.Array.from_buffers(
                    pa.large_binary(), n_lines,
                    [pa.py_buffer(np.packbits(is_first, bitorder="little")), pa.py_buffer(np.r_[0, np.cumsum(length)]), pa.py_buffer(keys)],
                ).cast(pa.binary())
                left[first], right[first] = parity[0].view(np.int64), parity[1].view(np.int64)
                sizes[first] = size
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(words.first + doc)), pa.array(number.astype(np.int32)), pa.array(sets.view(np.int64)),
                     pa.array(sizes), pa.array(left), pa.array(right), prefix],
                    names=["id", "line", "set", "size", "left", "right", "prefix"],
                )

    return read


def _cells(head: np.ndarray) -> np.ndarray:
    """Where in the sorted hashes ``head`` those with each value of the first ``CELL_BITS`` bits start."""
    return np.searchsorted(head >> np.uint64(64 - CELL_BITS), np.arange(1 << CELL_BITS, dtype=np.uint64)).astype(np.int32)


def _place(head: np.ndarray, cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``np.searchsorted(head, hashes)``, from the start of each hash's cell on."""
    ended = np.append(head, np.uint64(2**64 - 1))
    at = cells[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int32)]
    behind = np.flatnonzero(ended[at] < hashes)
    while len(behind):
        at[behind] += 1
        behind = behind[ended[at[behind]] < hashes[behind]]
    return at


def _parities(hashes: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """128 bits for each set: whether an odd number of its words is in that hash class."""
    bit = np.uint64(1) << (hashes >> np.uint64(40) & np.uint64(63))
    half = (hashes >> np.uint64(50) & np.uint64(1)).astype(bool)
    return [np.bitwise_xor.reduceat(np.where(half == k, bit, np.uint64(0)), begin) for k in (False, True)]


def _close(left: np.ndarray, right: np.ndarray, i, j, total: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets with ``total`` words together may be similar: they differ in |a| + |b| - 2 common words, and in no more parities."""
    differ = np.bitwise_count(left[i] ^ left[j]).astype(np.int64) + np.bitwise_count(right[i] ^ right[j])
    return differ <= total - 2 * (-(-total * percent // (100 + percent)))


def _keys(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes >> np.uint64(32), 1)


def _posts(shared):
    """An Arrow function over sets in their order: each set's posts, once.  Hot words are salted with the size."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, last = shared.value, None
        for batch in batches:
            sets = batch.column(0).to_numpy()
            if not len(sets):
                continue
            fresh = np.r_[last is None or sets[0] != last, sets[1:] != sets[:-1]]
            last = sets[-1]
            batch = batch.filter(pa.array(fresh))
            prefix = batch.column(4).to_pylist()
            length = np.array([len(x) // 4 for x in prefix], np.int64)
            keys = np.frombuffer(b"".join(prefix), "<u4")
            row = np.repeat(np.arange(len(length)), length)
            position = np.arange(len(keys)) - (np.cumsum(length) - length)[row]
            some = keys > 0
            keys, row, position = keys[some], row[some], position[some]
            set_, size, left, right = (batch.column(k).to_numpy()[row] for k in range(4))
            salt = np.where(np.isin(keys, hot), size, 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int32)), pa.array(salt), pa.array(size), pa.array(position.astype(np.int32)),
                 pa.array(set_), pa.array(left), pa.array(right)],
                names=["key", "salt", "size", "position", "set", "left", "right"],
            )

    return post


def _lists(percent: int):
    """An Arrow function over posts in the order of (key, salt, size): candidate pairs (a, b), and the sets of lists that are
    compared in blocks: a, key, block, size."""

    def pairs(part: dict, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists, none larger than a block."""
        n = len(part["set"])
        count = np.diff(np.append(starts, n))
        of = np.repeat(np.arange(len(starts)), count)
        ends = (starts + count)[of]
        size, position = part["size"].astype(np.int64), part["position"]
        # A set's rest starts at its position; the smaller set comes first.
        rest = size - position
        made, many = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
        found, active, step = [], np.arange(n), 0
        while len(active):
            step += 1
            active = active[active + step < ends[active]]
            j = active + step
            active = active[(size[active] * 100 >= size[j] * percent) & ~many[of[active]]]
            if not len(active):
                break
            j = active + step
            total = size[active] + size[j]
            near = np.minimum(rest[active], rest[j]) * (100 + percent) >= total * percent
            near &= part["set"][active] != part["set"][j]
            i, j, total = active[near], j[near], total[near]
            near = _close(part["left"], part["right"], i, j, total, percent)
            i, j = i[near], j[near]
            if len(i):
                made += np.bincount(of[i], minlength=len(made))
                many |= made > PAIRS * count
                found.append((i, j))
        if found:
            i, j = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            few = ~many[of[i]]
            a, b = part["set"][i[few]], part["set"][j[few]]
            yield rows(np.minimum(a, b), np.maximum(a, b))
        if many.any():
            k = np.flatnonzero(many[of])
            weight = np.cumsum(_weight(size))
            before = np.r_[0, weight][starts]
            yield rows(part["set"][k], None, part["key"][k], (weight - before[of])[k] // BLOCK_WORDS, part["size"][k])

    def rows(a, b=None, key=None, block=None, size=None) -> pa.RecordBatch:
        null = lambda kind: pa.nulls(len(a), kind)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), null(pa.int64()) if b is None else pa.array(b), null(pa.int32()) if key is None else pa.array(key),
             null(pa.int64()) if block is None else pa.array(block), null(pa.int32()) if size is None else pa.array(size)],
            names=["a", "b", "key", "block", "size"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "salt", "size", "position", "set", "left", "right"]
        held: dict | None = None
        streamed, at = None, 0  # the list that is given out block by block, and the weight of its sets so far
        for batch in _runs(batches):
            if batch is not None:
                part = {c: batch[c].to_numpy() for c in names}
                part["left"], part["right"] = part["left"].view(np.uint64), part["right"].view(np.uint64)
                held = part if held is None else {c: np.concatenate([held[c], part[c]]) for c in names}
            if held is None or not len(held["key"]):
                continue
            n = len(held["key"])
            starts = np.flatnonzero(np.r_[True, (held["key"][1:] != held["key"][:-1]) | (held["salt"][1:] != held["salt"][:-1])])
            sizes = np.diff(np.append(starts, n))
            # The last list may go on.  It waits until it ends or is larger than a block.
            waits = batch is not None and sizes[-1] <= BLOCK and (held["key"][-1], held["salt"][-1]) != streamed
            whole = len(starts) - 1 if waits else len(starts)
            large = (sizes > BLOCK) | (held["salt"][starts] > 0)
            large[0] |= (held["key"][0], held["salt"][0]) == streamed
            large[whole:] = False
            for k in np.flatnonzero(large):
                one = slice(starts[k], starts[k] + sizes[k])
                name = (held["key"][starts[k]], held["salt"][starts[k]])
                at = at if name == streamed else 0
                weight = at + np.cumsum(_weight(held["size"][one]))
                streamed, at = name, int(weight[-1])
                block = weight // BLOCK_WORDS + (int(name[1]) << 32)
                yield rows(held["set"][one], None, held["key"][one], block, held["size"][one])
            to = n if not waits else int(starts[-1])
            keep = np.repeat(~large, sizes)
            keep[to:] = False
            if keep.any():
                small = {c: held[c][keep] for c in names}
                fresh = np.r_[True, (small["key"][1:] != small["key"][:-1]) | (small["salt"][1:] != small["salt"][:-1])]
                yield from pairs(small, np.flatnonzero(fresh))
            held = {c: held[c][to:] for c in names}

    return search


def _weight(size: np.ndarray) -> np.ndarray:
    """What a set takes of a block: no block has more than ``BLOCK`` sets or, but for its first one, ``BLOCK_WORDS`` words."""
    return np.maximum(size.astype(np.int64), BLOCK_WORDS // BLOCK)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | None]:
    """Batches put together to runs of 200,000 rows or some more, and None behind the last."""
    parts = []
    for batch in batches:
        parts.append(batch)
        if sum(len(p) for p in parts) >= 200_000:
            yield pa.Table.from_batches(parts)
            parts = []
    if parts:
        yield pa.Table.from_batches(parts)
    yield None


def _cell_links(percent: int):
    """An Arrow function over the sets of one or two blocks: each set with the earliest of the others that is similar, if that is earlier."""

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.select(["block", "set", "id", "line", "words"]).sort_by([("id", "ascending"), ("line", "ascending")]).combine_chunks()
        block, names = cell["block"].to_numpy(), cell["set"].to_numpy()
        two = block.min() != block.max()
        size = pc.list_value_length(cell["words"]).to_numpy().astype(np.int64)
        words = np.concatenate([c.flatten().to_numpy() for c in cell["words"].chunks])
        starts = np.cumsum(size) - size
        parity = _parities(words.view(np.uint64), starts)
        words = np.unique(words, return_inverse=True)[1]
        mark = np.zeros(words.max(initial=0) + 1, bool)
        left = np.ones(len(names), bool)  # sets without an earlier one as yet
        a, b = [], []
        for i in range(len(names) - 1):
            j = i + 1 + np.flatnonzero(left[i + 1 :])
            if two:
                j = j[block[j] != block[i]]
            j = j[np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent]
            j = j[_close(*parity, i, j, size[i] + size[j], percent)]
            if not len(j):
                continue
            own = words[starts[i] : starts[i] + size[i]]
            mark[own] = True
            ends = np.cumsum(size[j])
            at = np.arange(ends[-1]) + np.repeat(starts[j] - (ends - size[j]), size[j])
            common = np.add.reduceat(mark[words[at]].astype(np.int64), ends - size[j])
            mark[own] = False
            j = j[common * 100 >= (size[i] + size[j] - common) * percent]
            left[j] = False
            a.append(names[j])
            b.append(np.repeat(names[i], len(j)))
        none = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return search


def _members(marks):
    """An Arrow function over (id, text): the words of the lines whose sets are wanted, once per run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(1)):
                hashes, bounds, _, _ = line_sets(words)
                if not len(hashes):
                    continue
                sets, first = np.unique(_identity(hashes, bounds), return_index=True)
                wanted = _is_marked(marks.value, sets)
                some = first[wanted]
                if len(some):
                    size = np.diff(bounds)[some]
                    ends = np.cumsum(size)
                    at = np.arange(ends[-1]) + np.repeat(bounds[some] - (ends - size), size)
                    column = pa.LargeListArray.from_arrays(np.r_[0, ends], pa.array(hashes[at].view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sets[wanted].view(np.int64)), column.cast(pa.list_(pa.int64()))], names=["set", "words"]
                    )

    return find


def _marks(keys: DataFrame) -> np.ndarray:
    """A bit array of a column ``key``."""
    bit = F.col("key").bitwiseAND((1 << MARK_BITS) - 1)
    bits = keys.groupBy(F.shiftright(bit, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(key & 63 as int))")).alias("bits")
    ).toArrow()
    marked = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    marked[bits["at"].to_numpy()] = bits["bits"].to_numpy().view(np.uint64)
    return marked


def _is_marked(marked: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64((1 << MARK_BITS) - 1)
    return (marked[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _block_links(blocks: DataFrame, members: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets of blocks of one list: of each set and pair of blocks the one with the earliest other set."""
    span = materialize(blocks.groupBy("key", "block").agg(F.min("size").alias("low"), F.max("size").alias("high")))
    p = span.select("key", F.col("block").alias("p"), F.col("low").alias("low_p"), F.col("high").alias("high_p"))
    q = span.select("key", F.col("block").alias("q"), F.col("low").alias("low_q"), F.col("high").alias("high_q"))
    cells = p.join(q, "key").where(
        f"p <= q AND low_q * {percent} <= high_p * 100 AND low_p * {percent} <= high_q * 100"
    ).select("key", "p", "q")
    cells = materialize(cells)
    sides = cells.withColumn("block", F.col("p")).union(cells.where("p < q").withColumn("block", F.col("q")))
    full = members.join(first, "set").select("set", "first.id", "first.line", "words")
    cells = blocks.select("key", "block", "set").join(full, "set").join(sides, ["key", "block"]).groupBy("key", "p", "q")
    return cells.applyInArrow(_cell_links(percent), "a long, b long").distinct()


def similar_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line that goes: doc_id, line (from 0), like_doc_id, like_line.

    A line goes if an earlier one, by document id and line number, has a Jaccard similarity of ``percent`` / 100
    or more on the sets of their words; the earliest such line is named.  Lines are judged on the input.  Lines without words
    stay, as do null and empty texts.  A null id comes behind all others.  Rows that repeat an id and a text are
    told apart by nothing, so their lines go alike: only against earlier ids and lines.  Other columns are not read.
    """
    spark = docs.sparkSession
    last = 2**63 - 1
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(last)).alias("id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1"))
    floor = count_floor(counts, "n", MOST_WORDS)
    head = counts.where(F.col("n") >= floor).toArrow()
    words, n = head["word"].to_numpy().view(np.uint64), head["n"].to_numpy()
    # The head's words by hash, with their ranks by count, and their keys by rank.
    by_rank = np.lexsort((words, n))
    rank = np.empty(len(n), np.uint64)
    rank[by_rank] = np.arange(len(n))
    by_hash = np.argsort(words)
    marked = _marks(counts.select(F.col("word").alias("key")))
    shared = spark.sparkContext.broadcast((words[by_hash], _cells(words[by_hash]), rank[by_hash], _keys(words[by_rank]), marked))
    read = materialize(texts.mapInArrow(_read(percent, shared), "id long, line int, set long, size int, left long, right long, prefix binary"))
    lines = read.select("id", "line", "set")
    # Lines meet by their sets before anything is posted.
    sets = read.where("prefix IS NOT NULL").select("set", "size", "left", "right", "prefix").repartition("set").sortWithinPartitions("set")
    hot = spark.sparkContext.broadcast(np.unique(_keys(words[n >= HOT])).astype(np.uint32))
    order = ["key", "salt", "size"]
    posts = sets.mapInArrow(_posts(hot), "key int, salt int, size int, position int, set long, left long, right long")
    posts = posts.repartition("key", "salt").sortWithinPartitions(*order)
    found = materialize(posts.mapInArrow(_lists(percent), "a long, b long, key int, block long, size int"))
    pairs = materialize(found.where("b IS NOT NULL").select("a", "b").distinct())
    blocks = found.where("b IS NULL").select("key", "block", F.col("a").alias("set"), "size")
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).union(blocks.select("set")).distinct()
    marks = spark.sparkContext.broadcast(_marks(wanted.select(F.col("set").alias("key"))))
    members = texts.mapInArrow(_members(marks), "set long, words array<long>")
    members = materialize(members.join(wanted, "set", "left_semi").groupBy("set").agg(F.first("words").alias("words")))
    left = members.select(F.col("set").alias("a"), F.col("words").alias("wa"))
    right = members.select(F.col("set").alias("b"), F.col("words").alias("wb"))
    common = F.size(F.array_intersect("wa", "wb"))
    held = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    held = held.where(F.col("common") * 100 >= (F.size("wa") + F.size("wb") - F.col("common")) * percent).select("a", "b")
    # Each set's first line, and the first line among its own and those of similar sets.
    first = materialize(lines.groupBy("set").agg(F.min(F.struct("id", "line")).alias("first")))
    if blocks.limit(1).count():
        held = held.union(_block_links(blocks, members, first, percent))
    held = materialize(held)
    both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(first, F.col("b") == F.col("set")).groupBy("a").agg(F.min("first").alias("near"))
    best = first.join(near, F.col("set") == F.col("a"), "left").select(
        "set", F.when(F.col("near") < F.col("first"), F.col("near")).otherwise(F.col("first")).alias("best")
    )
    gone = lines.join(best, "set").where(F.struct("id", "line") > F.col("best"))
    name = lambda c: F.when(c != last, c)
    return gone.select(
        name(F.col("id")).alias("doc_id"), "line", name(F.col("best.id")).alias("like_doc_id"), F.col("best.line").alias("like_line")
    )
