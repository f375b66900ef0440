"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame operations only.

Every document draws an exponential key, divided by its quality weight (Efraimidis and Spirakis).  Within a
source the documents are sorted by key and their sizes summed up to the source's budget.  Where
the target exceeds the source, complete epochs of it come first and the rest is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webposture.llm.tables import fresh
from webposture.session import materialize

#: A source is repeated so often at most.
MOST_EPOCHS = 3
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on ``key`` only, so that reruns agree."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0) -> DataFrame:
    """Add ``target`` to a table of (source, source_size).

    The budget, ``share`` of all sizes, is shared out by weight; no target exceeds ``MOST_EPOCHS`` times its
    source, and what is above goes to the others by weight until none is.  That is a water level: a target is
    the lesser of limit and level times weight, and the level is the greatest of those that follow when the
    sources that fill up first are taken away one after the other.  The table has a row per source, which one
    task can sort.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    table = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size").cast("double") * MOST_EPOCHS)
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    later = filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    budget = F.sum(F.col("source_size").cast("double")).over(everything) * share
    level = (budget - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))) / F.sum("weight").over(later)
    table = table.withColumn("level", level)
    return table.select(
        "source", "source_size", F.least("limit", F.max("level").over(everything) * F.col("weight")).alias("target")
    )


def decisions(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each document: doc_id, text_hash, source, size, n_rows, source_size, target, copies.

    ``quality``: a table (doc_id, quality) of sampling weights above 0, one row per id; documents without one
    weigh 1.  Rows that repeat an id, a text and a source are one unit (``n_rows``) and share their fate.  A unit
    is taken while the middle of it is within the budget, so a source misses its target by half a unit at most.
    A null source is a source of its own, a null id an id like others, and a null or empty text has size 0.
    """
    units = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    ).groupBy("source", "doc_id", "text_hash", "size").agg(F.count("*").alias("n_rows"))
    if quality is not None:
        weight = quality.select(F.col("doc_id"), F.col("quality").cast("double").alias("quality"))
        units = units.join(weight, "doc_id", "left")
        rate = F.when(F.col("quality") > 0, F.col("quality")).otherwise(1.0)
    else:
        rate = F.lit(1.0)
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) / rate
    units = units.select("source", key.alias("key"), "doc_id", "text_hash", "size", "n_rows")
    order = ["source", "key", "doc_id", "text_hash", "size"]
    # Ranges, so that a large source spreads over many tasks; written, so that a range's number stays.
    placed = materialize(
        units.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("chunk", F.spark_partition_id())
    )
    words_of = F.sum(F.col("size") * F.col("n_rows"))
    chunk = placed.groupBy("source", "chunk").agg(words_of.alias("chunk_size"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk.select(
        F.col("source").alias("of"), F.col("chunk").alias("at"),
        F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("offset"),
    )
    per_source = targets(chunk.groupBy("source").agg(F.sum("chunk_size").alias("source_size")), weights, share)
    offsets = materialize(
        offsets.join(per_source, F.col("of").eqNullSafe(F.col("source"))).drop("source")
    )
    inside = Window.partitionBy("source", "chunk").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    ran = placed.withColumn("before", F.coalesce(words_of.over(inside), F.lit(0)))
    ran = ran.join(offsets, (F.col("chunk") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    before = (F.col("before") + F.col("offset")).cast("double")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    # A source at its limit has no rest, and units without words take nothing of it.
    extra = F.when((epochs < MOST_EPOCHS) & (2 * before + F.col("size") * F.col("n_rows") <= 2 * rest), 1).otherwise(0)
    return ran.select(
        "doc_id", "text_hash", "source", "size", "n_rows", "source_size", "target", (epochs + extra).cast("int").alias("copies")
    )


def mix_report(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words in the mix, repeats counted)."""
    found = decisions(docs, quality, **options)
    found = found.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))).alias("_"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, ``MOST_EPOCHS`` times at most.

    Rows that repeat an id, a text and a source are taken alike, null ids and sources are values like others, texts without words come as often as
    the epochs of their source.  Columns stay as they are, whatever their names; an empty table stays empty.
    """
    names = {k: options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    of_id, of_text, of_source, copies, hashed, copy = fresh(docs, "of_id", "of_text", "of_source", "copies", "hashed", "copy")
    take = decisions(docs, quality, **options).where("copies > 0").select(
        F.col("doc_id").alias(of_id), F.col("text_hash").alias(of_text), F.col("source").alias(of_source), F.col("copies").alias(copies)
    )
    keyed = docs.withColumn(hashed, F.xxhash64(F.col(names["text_col"])))
    taken = keyed.join(
        take,
        (F.col(hashed) == F.col(of_text)) & F.col(names["id_col"]).eqNullSafe(F.col(of_id))
        & F.col(names["source_col"]).eqNullSafe(F.col(of_source)),
    )
    return taken.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(copy)).drop(copy)
