"""Readers of the collected-data tables, batch and streaming.

Schemas are explicit.  Columns a query does not use are pruned at the scan, above all ``body``.  Rows that do not
parse, or lack what a check needs, are not read as rows of nulls: they go to a quarantine that says why.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webposture import schemas

_BROKEN = "_corrupt_record"


@dataclass(frozen=True)
class Kind:
    """A table's schema and the columns that no row may lack."""

    schema: T.StructType
    required: tuple[str, ...]


TARGETS = Kind(schemas.TARGETS, ("scan_id", "target_url"))
RESPONSES = Kind(schemas.RESPONSES, ("scan_id", "url"))
ROBOTS = Kind(schemas.ROBOTS_FILES, ("origin",))
DNS = Kind(schemas.DNS_RECORDS, ("domain", "owner", "rrtype"))
TLS = Kind(schemas.TLS_OBSERVATIONS, ("domain",))
CT = Kind(schemas.CT_ENTRIES, ("domain", "name_value"))
REQUEST_LOG = Kind(schemas.REQUEST_LOG, ("domain", "ts"))
SCAN_EVENTS = Kind(schemas.SCAN_EVENTS, ("scan_id", "status"))


@dataclass(frozen=True)
class Checked:
    """What a reader found.

    ``rows`` has the rows that can be used.  ``quarantine`` has the others as (reason, record): ``unreadable`` with the line as it stands,
    or ``missing`` and the first column that is not there, with the row as JSON.
    """

    rows: DataFrame
    quarantine: DataFrame

    def counts(self) -> DataFrame:
        """Rows of the quarantine by reason."""
        return self.quarantine.groupBy("reason").agg(F.count("*").alias("n"))


def _reason(kind: Kind, lines: bool) -> Column:
    """Why a row cannot be used; NULL if it can."""
    reason = F.when(F.col(_BROKEN).isNotNull(), F.lit("unreadable")) if lines else F.when(F.lit(False), F.lit(""))
    for name in kind.required:
        reason = reason.when(F.col(name).isNull(), F.lit(f"missing {name}"))
    return reason


def _parsed_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, an object or an array of objects each, with what does not parse in ``_corrupt_record``.

    They are read as text: Spark's reader leaves out columns that a query does not use, and then a line that is broken
    there would count as sound in one query and not in another.
    """
    marked = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    line = F.col("value")
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    broken = F.array(F.struct(*nothing, line.alias(_BROKEN)))
    one = F.from_json(line, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    several = F.transform(
        F.from_json(line, T.ArrayType(schema), {"mode": "PERMISSIVE"}),
        lambda x: F.struct(*[x[f.name].alias(f.name) for f in schema.fields], F.lit(None).cast("string").alias(_BROKEN)),
    )
    rows = F.when(F.ltrim(line).startswith("["), F.coalesce(several, broken)).otherwise(F.coalesce(F.array_compact(F.array(one)), broken))
    return spark.read.text(path).filter(F.trim(line) != "").select(F.explode(rows).alias("row")).select("row.*")


def read_checked(spark: SparkSession, path: str, kind: Kind, fmt: str = "parquet") -> Checked:
    """Read a table of ``kind``.  Of the formats only JSON has rows that do not parse."""
    lines = fmt == "json"
    read = _parsed_lines(spark, path, kind.schema) if lines else spark.read.format(fmt).schema(kind.schema).load(path)
    reason = _reason(kind, lines)
    whole = F.to_json(F.struct(*kind.schema.names))
    record = F.coalesce(F.col(_BROKEN), whole) if lines else whole
    return Checked(
        read.filter(reason.isNull()).select(*kind.schema.names),
        read.select(reason.alias("reason"), record.alias("record")).filter("reason IS NOT NULL"),
    )


def read_targets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, TARGETS, fmt).rows


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, RESPONSES, fmt).rows


def stream_responses(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Responses as they land; a file limit bounds what one micro-batch holds."""
    reader = spark.readStream.format(fmt).schema(schemas.RESPONSES)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).filter(_reason(RESPONSES, False).isNull())


def served(files: DataFrame) -> DataFrame:
    """Robots files with the content that counts: that of 2xx answers, everything else means no rules."""
    return files.withColumn("content", F.when(F.col("status").between(200, 299), F.col("content")))


def read_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return served(read_checked(spark, path, ROBOTS, fmt).rows)


def read_dns(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, DNS, fmt).rows


def read_tls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, TLS, fmt).rows


def read_ct(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Certificate-transparency entries; other JSON keys are ignored."""
    return read_checked(spark, path, CT, fmt).rows


def read_request_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, REQUEST_LOG, fmt).rows


def read_scan_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_checked(spark, path, SCAN_EVENTS, fmt).rows
