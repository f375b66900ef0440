"""Document fingerprints by Order MinHash, in DataFrame operations only.

The k-mers of a text are its runs of ``KMER`` words, numbered by occurrence, so that the second "of the" differs from
the first.  Every numbered k-mer has a place on a circle of 64-bit hashes.  Each of ``SLOTS`` evenly spread points takes
the ``TUPLE`` numbered k-mers that follow it there: the minimal ones of an order of its own.  These are
put back into the order in which the text has them, and the hash of that tuple of k-mers is the slot's value.
Two texts agree in a slot if the same k-mers are minimal and follow each other in the same order; so the share of equal slots
falls with the edit distance, also where words are only moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webposture.operators.ordering import with_rank
from webposture.session import materialize

#: Words of a k-mer, k-mers of a tuple, values of a fingerprint.
KMER, TUPLE, SLOTS = 2, 2, 64
#: Bits that hold a position in a text; beyond, in texts of some 400 MB, positions start again from 0.
AT_BITS = 26


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _below(ordered: Column, n: Column, bound: Column) -> Column:
    """How many values of an array in ascending order are less than ``bound``, by halving; it has ``n``."""
    bits = F.ceil(F.log2(n + 1)).cast("int")
    steps = F.slice(F.array(*[F.lit(1 << b) for b in reversed(range(31))]), -bits, bits)
    # Beyond the end there is null, which is not less.
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(ordered, low + step - 1) < bound, low + step).otherwise(low))


def kmers(text: Column, size: int = KMER) -> Column:
    """A hash of each run of ``size`` words ``[^\\x20\\x09-\\x0D]+``; a text of fewer words is one k-mer, one without words has none."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(word: Column) -> Column:
        last = F.size(word) - size
        return F.when(
            last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(size)]))
        ).when(F.size(word) > 0, F.array(F.xxhash64(word))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _circle(found: Column) -> Column:
    """The places of all k-mers in order.  Their last ``AT_BITS`` bits are where in the text the k-mer is."""
    low = F.lit((1 << AT_BITS) - 1)
    by_kmer = F.sort_array(F.transform(found, lambda k, i: F.shiftleft(k, AT_BITS).bitwiseOR(i.cast("long").bitwiseAND(low))))

    def place(run: Column) -> Column:
        # Equal k-mers stand side by side in text order.  Only one that is not the first needs a search for its run.
        def occurrence(x: Column, i: Column) -> Column:
            kmer = F.shiftright(x, AT_BITS)
            return F.when(F.shiftright(F.get(run, i - 1), AT_BITS) == kmer, i - _below(run, i, F.shiftleft(kmer, AT_BITS))).otherwise(F.lit(0))

        return F.transform(run, lambda x, i: F.shiftleft(F.xxhash64(F.shiftright(x, AT_BITS), occurrence(x, i)), AT_BITS).bitwiseOR(x.bitwiseAND(low)))

    return F.sort_array(_let(by_kmer, place))


def signature(text: Column, size: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS) -> Column:
    """The fingerprint as an array of ``slots`` ints; a null text counts as empty.

    All texts without words have the same fingerprint.  Of a text with fewer k-mers than a tuple has places, k-mers repeat.
    """
    low = F.lit((1 << AT_BITS) - 1)
    points = F.array(*[F.lit(t * (2**64 // slots) - 2**63) for t in range(slots)])

    def select(found: Column, circle: Column) -> Column:
        n = F.size(circle)

        def value(point: Column) -> Column:
            def tuple_from(first: Column) -> Column:
                chosen = F.sort_array(F.array(*[F.get(circle, (first + k) % n).bitwiseAND(low) for k in range(tuple_size)]))
                return F.shiftright(F.xxhash64(*[F.get(found, F.get(chosen, F.lit(k)).cast("int")) for k in range(tuple_size)]), 32).cast("int")

            return _let(_below(circle, n, point), tuple_from)

        return F.when(n > 0, F.transform(points, value)).otherwise(F.array_repeat(F.lit(0), slots))

    return _let(kmers(F.coalesce(text, F.lit("")), size), lambda found: _let(_circle(found), lambda circle: select(found, circle)))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal values of two fingerprints, 0 to 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(values: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a value."""
    return F.lower(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(2**32 - 1))), 8, "0")), ""))


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    size: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS,
) -> DataFrame:
    """``doc_id`` and ``fingerprint``, one row per row of ``docs``.  Equal texts have equal fingerprints; null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), as_text(signature(text, size, tuple_size, slots)).alias("fingerprint"))


def edit_report(
    docs: DataFrame, share: int = 3, id_col: str = "doc_id", text_col: str = "text",
    size: int = KMER, tuple_size: int = TUPLE, slots: int = SLOTS,
) -> DataFrame:
    """How fingerprints tell an edited text from another one, one row per row of ``docs``.

    The next document is that with the next smaller id; nulls come last, and after the last one the first follows.  Documents
    with the same id come in an order of their texts' hashes, and rows with the same id and text are one document.  A null text
    is empty.  The last 1/``share`` of a text's code points (rounded down) are replaced by the first as many of the next
    document, or all it has.  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited (likeness to the edited text's fingerprint) and near_next (to the next document's).

    Texts are shuffled once; of the next document only the part that is taken over travels.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    units = rows.groupBy("doc_id", "hash").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    # Ids descend; a null one has a null rank key, which a leading flag puts last.
    keys = [F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not(F.col("doc_id").cast("long")).alias("down")]
    ranked = materialize(with_rank(units.select("*", *keys), [], ["none", "down", "hash"]).select("doc_id", "hash", "n_chars", "rank"))
    n = ranked.count()
    before = ranked.select(
        F.pmod(F.col("rank") + 1, F.lit(max(n, 1))).alias("rank"), F.col("doc_id").alias("to_id"), F.col("hash").alias("to_hash"),
        F.floor(F.col("n_chars") / share).cast("int").alias("wanted"),
    )
    units = materialize(ranked.join(before, "rank").withColumnRenamed("doc_id", "of_id").withColumnRenamed("hash", "of_hash"))
    same = (F.col("hash") == F.col("of_hash")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    placed = rows.join(units, same).drop("of_id", "of_hash")
    sent = placed.select("to_id", "to_hash", F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("tail"))
    sent = sent.dropDuplicates(["to_id", "to_hash"])
    met = placed.drop("to_id", "to_hash", "wanted").join(sent, (F.col("hash") == F.col("to_hash")) & F.col("doc_id").eqNullSafe(F.col("to_id")))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("tail"))
    scored = met.select("doc_id", "n_chars", "rank", "text", edited.alias("edited")).select(
        "doc_id", "n_chars", "rank", F.sha2("edited", 256).alias("edited_sha256"),
        signature(F.col("text"), size, tuple_size, slots).alias("own"), signature(F.col("edited"), size, tuple_size, slots).alias("other"),
    )
    scored = materialize(scored)
    following = scored.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("at"), F.col("own").alias("next")).dropDuplicates(["at"])
    return scored.join(following, F.col("rank") == F.col("at")).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
