"""Benchmark passages in documents by spaced seeds, in DataFrame operations only.

A seed is the hash of some of the words in a stretch of eight; a mask says which, so a word it leaves out may
differ.  Seeds of all positions of the documents meet those of the benchmark, and around each hit the
words are compared one by one.  The two masks below find every stretch of 13 words of which 11 are equal, wherever
the other two are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.llm.tables import blocks_for, fresh
from webposture.session import materialize

SPAN = 8
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: A window of so many words, of which so many must be equal.
WINDOW, EQUAL = 13, 11
#: Items shorter than the window must occur word for word, and have so many words at least.
SHORT = 5
#: Positions of a part of a document, and the words that it has on either side of them.
PART, MARGIN = 128, WINDOW + SPAN
#: Seeds of the benchmark in a block, of which twice as many may be broadcast; a row takes at most 300 bytes.
BLOCK_SEEDS = 100_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    runs = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(runs, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(hashes: Column, mask: tuple[int, ...], span: int, tag: int) -> Column:
    """The seed at each position."""
    last = F.size(hashes) - span
    at = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    found = F.transform(at, lambda i: F.xxhash64(F.lit(tag), *[F.get(hashes, i + o) for o in mask]))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<bigint>"))


def _parts(hashed: DataFrame) -> DataFrame:
    """The documents (doc_id, h) in parts: begin, first, last, n, part.

    Rows of seeds and hits hold their part's words, so a part is short and what a document takes grows with its length only.  A part
    answers for the positions first to last, counted from its own begin, and has the words that a seed or a window there needs.
    """
    n = F.size("h")
    begin = lambda base: F.greatest(base - MARGIN, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(PART)), lambda base: F.struct(
        begin(base).alias("begin"), (base - begin(base)).alias("first"), (F.least(base + PART, n) - 1 - begin(base)).alias("last"),
        F.slice("h", begin(base) + 1, F.lit(PART + 2 * MARGIN)).alias("part"),
    ))
    return hashed.select("doc_id", n.alias("n"), F.inline(cut))


def _part_seeds(mask: tuple[int, ...], span: int, tag: int) -> Column:
    """(seed, at) for the positions of a part, the last ``span - 1`` of the document left out."""
    last = F.least(F.col("last"), F.col("n") - span - F.col("begin"))
    at = F.sequence(F.col("first"), F.greatest(last, F.col("first")))
    found = F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(tag), *[F.get("part", i + o) for o in mask]).alias("seed"), i.alias("at")))
    return F.when(last >= F.col("first"), found).otherwise(F.array().cast("array<struct<seed: bigint, at: int>>"))


def benchmark_seeds(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, seed, back, context, window, equal: a row per seed with the words around it.

    ``context`` holds up to 18 words and ``back`` of them come before the seed.
    """
    items = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("h")).withColumn("n", F.size("h"))
    reach = WINDOW - SPAN
    long = items.where(f"n >= {WINDOW}")
    parts = [
        long.select("item_id", "h", F.posexplode(_seeds(F.col("h"), mask, SPAN, k)).alias("j", "seed")).select(
            "item_id", "seed", F.least("j", F.lit(reach)).alias("back"),
            F.slice("h", F.greatest(F.col("j") - reach, F.lit(0)) + 1, WINDOW + reach).alias("context"),
            F.lit(WINDOW).alias("window"), F.lit(EQUAL).alias("equal"),
        )
        for k, mask in enumerate(MASKS)
    ]
    short = items.where(f"n >= {SHORT} AND n < {WINDOW}")
    parts.append(short.select(
        "item_id", F.xxhash64(F.lit(len(MASKS)), *[F.get("h", F.lit(o)) for o in range(SHORT)]).alias("seed"),
        F.lit(0).alias("back"), F.col("h").alias("context"), F.col("n").alias("window"), F.col("n").alias("equal"),
    ))
    return reduce(DataFrame.unionByName, parts)


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, equal_words, first_word, last_word.

    A document holds an item if 13 words in a row of the item stand in the document with 11 of them equal, place by
    place; an item of 5 to 12 words must stand there whole, and one of fewer words is no evidence and is never found.
    ``equal_words`` is the most that a window had, the words between ``first_word`` and ``last_word`` hold all seeds.  Case
    and punctuation don't count.  Null and empty texts hold nothing and are found nowhere.  Rows with the same id are
    one document.  An empty table of either kind gives no rows, repeated items count one by one.  The benchmark is matched in blocks, each against
    all documents: a block is broadcast if it is as small as it should be; one that is not, since very many items share a phrase,
    is joined by a shuffle.  Texts of any length take time in proportion to it.
    """
    seeds = materialize(benchmark_seeds(benchmark, item_col, item_text_col))
    short = not seeds.where(F.col("window") < WINDOW).isEmpty()
    n_blocks = blocks_for(seeds.count(), BLOCK_SEEDS)
    hashed = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("h"))
    spans = [(mask, SPAN) for mask in MASKS] + [(tuple(range(SHORT)), SHORT)] * short
    found = F.concat(*[_part_seeds(mask, span, k) for k, (mask, span) in enumerate(spans)])
    placed = _parts(hashed).select("doc_id", "begin", "part", F.inline(found))
    # A block may hold many rows of one seed, and is then no broadcast.
    block_of = F.pmod(F.col("seed"), F.lit(n_blocks))
    sizes = {r["block"]: r["n"] for r in seeds.groupBy(block_of.alias("block")).agg(F.count("*").alias("n")).collect()}
    hits = []
    for block, size in sorted(sizes.items()):
        some = seeds.where(block_of == block)
        joined = placed.where(block_of == block) if size > 2 * BLOCK_SEEDS else placed
        joined = joined.join(F.broadcast(some) if size <= 2 * BLOCK_SEEDS else some, "seed")
        i = (F.col("begin") + F.col("at")).alias("i")
        hits.append(joined.select("doc_id", "item_id", i, "at", "part", "back", "context", "window", "equal"))
    if not hits:
        return docs.sparkSession.createDataFrame([], docs.select(F.col(id_col).alias("doc_id")).schema).join(
            benchmark.select(F.col(item_col).alias("item_id")).limit(0)
        ).select("doc_id", "item_id", *[F.lit(0).alias(n) for n in ("equal_words", "first_word", "last_word")])
    hit = reduce(DataFrame.unionByName, hits)
    same = F.transform("context", lambda word, k: F.coalesce(F.get("part", F.col("at") - F.col("back") + k) == word, F.lit(False)).cast("int"))
    hit = hit.withColumn("same", same)
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.size("same") - F.col("window")),
        lambda k: F.aggregate(F.slice("same", k + 1, F.col("window")), F.lit(0), lambda a, b: a + b),
    ))
    hit = hit.select("doc_id", "item_id", "i", "equal", best.alias("best")).where("best >= equal")
    return hit.groupBy("doc_id", "item_id").agg(
        F.max("best").alias("equal_words"), F.min("i").alias("first_word"), (F.max("i") + SPAN - 1).alias("last_word")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document holds no benchmark item."""
    (found_id,) = fresh(docs, "found_id")
    found = contamination(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(found_id)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(found_id)), "left_anti")
