"""From raw documents to token files: a corpus pipeline of five operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of documents, further columns included, whatever their names.  No stage fails on
nulls in any column, on empty or very long texts or on an empty table, which stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webposture.llm import decontaminate, mixing, near_dedup, queries, token_store, toxicity
from webposture.llm.text import held_out
from webposture.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half; it learns from the labels of the documents not held out.

    Texts without words, null ones too, score 0 and stay.  Rows that repeat a text share its fate, and without labels of both kinds all stay.
    """
    labels = queries.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"), 5)))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more: that with the smallest id.

    Texts without words are in no group and stay.  Of rows that repeat the id that stays, each stays; rows without an id go where another row has
    their text.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; texts without words have none, and rows with the same id are one document."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: some not at all, some up to three times.

    A null source is a source, a text without words has size 0, and rows that repeat an id, a text and a source are taken alike.
    """
    return mixing.mix(docs, queries.quality(spark, sf_dir))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document: doc_id, start, n_tokens, ids_crc32.

    In ascending order of ids, null ones first, repeated ones by text; a text without words has the end id alone.
    """
    return token_store.token_offsets(docs, queries.tokenizer_path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Compression lengths and the tokenizer can't be expressed in SQL; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = queries.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
