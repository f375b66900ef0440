"""Near duplicates by a MinHash LSH forest.

A document's shingle set has ``HASHES`` MinHash values.  Every tree of the forest is an order of the distinct
sets by a label, a sequence of ``DEPTH`` of these values.  In that order a set's candidates are its nearest
neighbours as long as they share a prefix of at least ``LEAST_DEPTH`` values with it.  Candidates whose signatures
agree enough are confirmed on the full sets.

The sets that share such a prefix are a region.  The search has three steps.  The nearest neighbours in a few trees connect
most of a group.  Then, in all trees, all pairs of a region that the neighbours reach are looked at, and those that are
not connected yet are candidates.  A region that is larger is crowded: its sets are dealt into blocks by component, and a task that
has two blocks compares all their sets, full ones too, and returns no more links than connect its components.  Blocks that are
one component together are left out.  So a
large group makes no more rows than a few for each of its sets and blocks, and every pair of a region is compared
that no other link connects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.components import components
from webposture.llm.tables import fresh, small
from webposture.llm.text import Words, chunks, counted, mix, rolling
from webposture.operators.ordering import with_rank
from webposture.session import materialize

HASHES = 128
TREES = 24
#: Trees, and neighbours on each side, that are looked at first.
FIRST_TREES = 6
FIRST_NEIGHBOURS = 4
DEPTH = 12
LEAST_DEPTH = 4
#: Neighbours on each side of a set in each order.
NEIGHBOURS = 32
#: Candidates are checked if their signatures agree in the share asked for less this.  Of pairs at exactly that similarity
#: 1.4 in a million agree in fewer places.
SLACK = 0.16
#: The same for the first search.  What it leaves out the later ones still find.
FIRST_SLACK = 0.12
#: Sets of a block of a crowded region, and shingles of all its sets.
BLOCK, BLOCK_SHINGLES = 2048, 4_000_000

_rng = np.random.default_rng(20_24)
_FACTOR = (_rng.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
#: Zero half-bytes of each byte.
_EQUAL = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)
#: Which values make up the labels.  The first ones of all trees differ as long as there are any.
_LABELS = np.stack([
    np.concatenate([np.roll(np.arange(HASHES), -t * LEAST_DEPTH)[:LEAST_DEPTH],
                    _rng.permutation(np.roll(np.arange(HASHES), -t * LEAST_DEPTH)[LEAST_DEPTH:])[: DEPTH - LEAST_DEPTH]])
    for t in range(TREES)
])


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document one after the other, and where each begins.

    Words are lower-cased (A-Z).  A document with fewer words has its whole sequence as its one shingle, one without
    words none.
    """
    hashes, offsets = words.hashes(lower=True), words.offsets
    count = np.diff(offsets)
    runs, rows = rolling(hashes, size), np.repeat(np.arange(words.n_docs), np.maximum(count - size + 1, 0))
    first = np.arange(len(rows)) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(count - size + 1, 0))])[:-1], np.maximum(count - size + 1, 0))
    shingles = runs[first]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = [mix(rolling(hashes[offsets[d] : offsets[d + 1]], int(count[d])) ^ np.uint64(count[d])) for d in few]
        rows, shingles = np.concatenate([rows, few]), np.concatenate([shingles, *whole])
        order = np.argsort(rows, kind="stable")
        rows, shingles = rows[order], shingles[order]
    starts = np.searchsorted(rows, np.arange(words.n_docs + 1))
    parts = [counted(shingles[a:b])[0] for a, b in zip(starts[:-1], starts[1:])]
    return np.concatenate([shingles[:0], *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of non-empty sets, one row each."""
    narrow = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, HASHES), np.uint32)
    scratch = np.empty_like(narrow)
    for k in range(HASHES):
        np.multiply(narrow, _FACTOR[k], out=scratch)
        scratch += _SHIFT[k]
        out[:, k] = np.minimum.reduceat(scratch, bounds[:-1])
    return out


def _read(size: int, what: str):
    """An Arrow function over (id, text): sets of documents with their signatures, or with their shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(1)):
                ids = batch.column(0).slice(words.first, words.n_docs)
                shingles, bounds = shingle_sets(words, size)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                # The set's identity: two sums over its shingles.
                left, right = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(some):
                    left[some] = np.add.reduceat(shingles, bounds[some])
                    right[some] = np.add.reduceat(mix(shingles ^ np.uint64(0xA5A5A5A5)), bounds[some])
                    left, right = mix(left ^ n.astype(np.uint64)), mix(right)
                columns = {"id": ids, "n": pa.array(n), "s1": pa.array(left.view(np.int64)), "s2": pa.array(right.view(np.int64))}
                if what == "signature":
                    found = np.zeros((len(n), HASHES), np.uint32)
                    if len(some):
                        found[some] = signatures(shingles, np.append(bounds[some], bounds[-1]))
                    column = _binary(found)
                else:
                    column = pa.LargeListArray.from_arrays(bounds, pa.array(shingles.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns.values(), column], names=[*columns, what])

    return read


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in rows], pa.binary())


_FOREST = "tree int, label binary, rep long, n long, short binary, component long"


def _trees(trees: int):
    """An Arrow function over sets: each once per tree, with its label there as bytes that sort like the numbers."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(-1, HASHES)
                # Least values are small numbers, so they are scrambled before they are cut short.
                hashed = mix(signature.astype(np.uint64) + np.arange(HASHES, dtype=np.uint64) * np.uint64(1 << 32))
                short = (hashed & np.uint64(15)).astype(np.uint8)
                short = short[:, ::2] | short[:, 1::2] << 4
                hashed = (hashed >> np.uint64(48)).astype(">u2")
                for tree in range(trees):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), tree, np.int32)), _binary(hashed[:, _LABELS[tree]]), part.column("rep"),
                         part.column("n"), _binary(short), part.column("component")],
                        names=["tree", "label", "rep", "n", "short", "component"],
                    )

    return grow


def _neighbours(percent: int, reach: int, slack: float, crowded: bool):
    """An Arrow function over sets in the order of (tree, label): pairs of neighbours in different components, up to
    ``reach`` places apart, whose signatures agree.  If ``crowded`` is not set, without those of crowded regions."""
    share = percent / 100
    # Values are known by 4 of their bits; that others agree by chance only adds candidates.
    least = int(np.ceil((share - slack) * HASHES))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch])
            carried = 0
            if kept is not None:
                carried = len(kept)
                table = pa.concat_tables([kept, table])
            kept = table.slice(max(0, len(table) - reach))
            tree = table["tree"].to_numpy()
            label = np.frombuffer(b"".join(table["label"].to_pylist()), ">u2").reshape(len(tree), DEPTH)
            short = np.frombuffer(b"".join(table["short"].to_pylist()), np.uint8).reshape(len(tree), HASHES // 2)
            rep, n, component = table["rep"].to_numpy(), table["n"].to_numpy(), table["component"].to_numpy()
            # Only what of a region is in this table is counted, so one may seem smaller than it is, never larger.
            begins = np.r_[True, (tree[1:] != tree[:-1]) | (label[1:, :LEAST_DEPTH] != label[:-1, :LEAST_DEPTH]).any(1)]
            size = np.bincount(np.cumsum(begins) - 1)[np.cumsum(begins) - 1]
            for step in range(1, min(reach, len(tree) - 1) + 1):
                i = np.arange(max(0, carried - step), len(tree) - step)
                j = i + step
                near = (tree[i] == tree[j]) & (label[i, :LEAST_DEPTH] == label[j, :LEAST_DEPTH]).all(1)
                # Sets of very different size cannot be similar.
                near &= component[i] != component[j]
                if not crowded:
                    near &= size[i] <= NEIGHBOURS + 1
                near &= np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
                i, j = i[near], j[near]
                if not len(i):
                    continue
                agree = _EQUAL[short[i] ^ short[j]].sum(1) >= least
                i, j = i[agree], j[agree]
                low, high = np.minimum(rep[i], rep[j]), np.maximum(rep[i], rep[j])
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])

    return scan


def near_duplicates(
    docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``percent`` / 100 or more;
    ``component_id`` is the smallest id that a document reaches over links, ``kept`` whether it is its own.
    Documents without words, and null texts, are linked with nothing.  Rows with equal sets are one node, named by its
    smallest id; null ids only name nodes that have no other, and of those each is its own component.  Other
    columns are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    read = "id long, n long, s1 long, s2 long, "
    sets = texts.mapInArrow(_read(shingle_words, "signature"), read + "signature binary")
    sets = materialize(sets)
    rows = sets.select("id", "n", "s1", "s2")
    # Copies meet before they are compared: one row per distinct set, with its smallest id.
    nodes = sets.where("n > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(
        F.min("id").alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    nodes = materialize(nodes)
    alone = _neighbour_pairs(nodes.withColumn("component", F.col("rep")), percent, FIRST_TREES, FIRST_NEIGHBOURS, FIRST_SLACK, True)
    seen = materialize(alone)
    near = materialize(_holding(texts, nodes, seen, shingle_words, percent))
    known = materialize(components(near))
    placed = nodes.join(known, F.col("rep") == F.col("node"), "left")
    placed = placed.select(*nodes.columns, F.coalesce("component", "rep").alias("component"))
    placed = materialize(placed)
    apart = materialize(_neighbour_pairs(placed, percent, TREES, NEIGHBOURS, SLACK, False).join(seen, ["a", "b"], "left_anti"))
    far = materialize(_holding(texts, nodes, apart, shingle_words, percent))
    crowd = _crowded_links(texts, placed, shingle_words, percent)
    if crowd is not None:
        far = far.union(crowd)
    # Components, and the links between them.
    named = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(far))
    nodes = nodes.select("s1", "s2", "rep").join(named, F.col("rep") == F.col("node"), "left")
    nodes = nodes.select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    linked = rows.join(nodes, ["s1", "s2"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return linked.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def _forest(nodes: DataFrame, trees: int) -> DataFrame:
    return nodes.select("rep", "n", "signature", "component").mapInArrow(_trees(trees), _FOREST)


def _neighbour_pairs(nodes: DataFrame, percent: int, trees: int, reach: int, slack: float, crowded: bool) -> DataFrame:
    """Pairs (a, b) of neighbours in the forest that are in different components."""
    order = ["tree", "label", "rep"]
    return (
        _forest(nodes, trees).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_neighbours(percent, reach, slack, crowded), "a long, b long").distinct()
    )


def _cell_links(percent: int):
    """An Arrow function over the sets of one or two blocks: links (a, b) that connect what is similar in different components.

    Of two blocks, each set of the first is compared with all of the second.
    """
    least = int(np.ceil((percent / 100 - SLACK) * HASHES))

    def search(cell: pa.Table) -> pa.Table:
        cell = cell.select(["block", "rep", "n", "component", "short", "shingles"]).sort_by("block").combine_chunks()
        block, rep, n = (cell[c].to_numpy() for c in ("block", "rep", "n"))
        component = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
        short = np.frombuffer(b"".join(cell["short"].to_pylist()), np.uint8).reshape(len(rep), HASHES // 2)
        shingles = np.unique(np.concatenate([c.flatten().to_numpy() for c in cell["shingles"].chunks]), return_inverse=True)[1]
        starts = np.cumsum(n) - n
        mark = np.zeros(shingles.max(initial=0) + 1, bool)
        second = int(np.searchsorted(block, block[0], "right"))
        a, b = [], []
        for i in range(second if second < len(rep) else len(rep) - 1):
            later = max(second, i + 1) if second < len(rep) else i + 1
            j = later + np.flatnonzero(component[later:] != component[i])
            j = j[np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent]
            j = j[_EQUAL[short[j] ^ short[i]].sum(1) >= least]
            if not len(j):
                continue
            own = shingles[starts[i] : starts[i] + n[i]]
            mark[own] = True
            ends = np.cumsum(n[j])
            at = np.arange(ends[-1]) + np.repeat(starts[j] - (ends - n[j]), n[j])
            common = np.add.reduceat(mark[shingles[at]].astype(np.int64), ends - n[j])
            mark[own] = False
            j = j[common * 100 >= (n[i] + n[j] - common) * percent]
            met, first = np.unique(component[j], return_index=True)
            a.extend(rep[[i] * len(met)])
            b.extend(rep[j[first]])
            component[np.isin(component, met)] = component[i]
        low, high = np.minimum(np.array(a, np.int64), np.array(b, np.int64)), np.maximum(np.array(a, np.int64), np.array(b, np.int64))
        return pa.table({"a": low, "b": high})

    return search


def _crowded_links(texts: DataFrame, nodes: DataFrame, shingle_words: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect what is similar in crowded regions; None if there are no such regions.

    Regions that share sets make up a group.  Its sets, in the order of their first regions, are dealt into blocks, and blocks
    that share a region meet in a cell.
    """
    forest = _forest(nodes, TREES).withColumn("region", F.expr(f"substring(label, 1, {2 * LEAST_DEPTH})"))
    regions = materialize(
        forest.groupBy("tree", "region").agg(
            F.count("*").alias("sets"), F.min("rep").alias("first"), F.min("component").alias("low"), F.max("component").alias("high")
        ).where((F.col("sets") > NEIGHBOURS + 1) & (F.col("low") < F.col("high"))).select("tree", "region", "first")
    )
    if not regions.limit(1).count():
        return None
    places = materialize(
        forest.join(small(regions), ["tree", "region"])
        .select("rep", "n", "component", "short", F.concat(F.format_string("%03d", "tree"), F.hex("region")).alias("region"), "first")
    )
    groups = components(places.select(F.col("rep").alias("a"), F.col("first").alias("b"))).withColumnRenamed("component", "family")
    sets = places.groupBy("rep").agg(
        F.min("region").alias("region"), F.first("n").alias("n"), F.first("component").alias("component"), F.first("short").alias("short")
    ).join(groups, F.col("rep") == F.col("node")).drop("node")
    # Sets that are connected already lie side by side, so that most blocks are of one component.
    sets = with_rank(sets, ["family"], ["component", "region", "rep"]).drop("chunk", "first")
    most = sets.groupBy("family").agg(F.max("n").alias("most"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.col("most"))))
    sets = materialize(sets.join(most, "family").withColumn("block", F.floor(F.col("rank") / room)).drop("region", "rank", "most"))
    blocks = materialize(places.select("rep", "region").join(sets.select("rep", "family", "block"), "rep").drop("rep").distinct())
    other = blocks.select("region", F.col("block").alias("q"))
    cells = blocks.withColumnRenamed("block", "p").join(other, "region").where("p <= q").select("family", "p", "q").distinct()
    # Two blocks of the same single component have nothing to find: only what is outside of a region's large components is compared.
    span = materialize(sets.groupBy("family", "block").agg(F.min("component").alias("low"), F.max("component").alias("high")))
    for side in ("p", "q"):
        cells = cells.join(span.select("family", F.col("block").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}")), ["family", side])
    cells = cells.where("least(low_p, low_q) < greatest(high_p, high_q)").select("family", "p", "q")
    cells = materialize(cells)
    sides = cells.withColumn("block", F.col("p")).union(cells.where("p < q").withColumn("block", F.col("q")))
    full = _full(texts, nodes, sets.select("rep"), shingle_words).select("rep", "shingles")
    found = sets.join(full, "rep").join(sides, ["family", "block"]).groupBy("family", "p", "q")
    return materialize(found.applyInArrow(_cell_links(percent), "a long, b long").distinct())


def _full(texts: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """The full sets of the nodes wanted: rep, n, shingles."""
    return materialize(
        texts.join(wanted, F.col("id") == F.col("rep"), "left_semi")
        .mapInArrow(_read(shingle_words, "shingles"), "id long, n long, s1 long, s2 long, shingles array<long>")
        .join(nodes.select("s1", "s2", "rep"), ["s1", "s2"]).where("id = rep").select("rep", "n", "shingles")
        .dropDuplicates(["rep"])
    )


def _holding(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs that hold on the full sets."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    full = _full(texts, nodes, materialize(wanted), shingle_words)
    a = full.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = full.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    found = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    found = found.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent)
    return found.select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component.  Of rows that repeat a kept id, each stays."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    (gone_id,) = fresh(docs, "gone_id")
    gone = found.where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col(gone_id), "left_anti")
