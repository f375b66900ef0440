"""Report writers and the streaming sink."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webposture import schemas
from webposture.operators.findings import FIELDS
from webposture.operators.report import REPORT_ORDER, finding_rows, ranked_findings
from webposture.session import materialize, scratch


#: Quotes are doubled, a missing line is blank.  Without emptyValue Spark writes "" for empty text.
_CSV = {
    "header": "true", "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


def write_report_json(info: DataFrame, summary: DataFrame, findings: DataFrame, path: str) -> None:
    """scan_info, summary and findings as JSON lines below ``path``; a missing line is null."""
    keep_nulls = {"ignoreNullFields": "false"}
    info.write.mode("overwrite").options(**keep_nulls).json(f"{path}/scan_info")
    summary.write.mode("overwrite").options(**keep_nulls).json(f"{path}/summary")
    ordered = ranked_findings(findings).orderBy("scan_id", *REPORT_ORDER).select("scan_id", *FIELDS)
    ordered.write.mode("overwrite").options(**keep_nulls).json(f"{path}/findings")


def write_report_csv(findings: DataFrame, path: str) -> None:
    """Findings, most severe first, with header; quotes are doubled, a missing line is blank."""
    ordered = ranked_findings(findings).orderBy(*REPORT_ORDER).select("scan_id", *FIELDS)
    ordered.write.mode("overwrite").options(**_CSV).csv(path)


def write_scan_reports(
    info: DataFrame, summary: DataFrame, findings: DataFrame, path: str, fmt: str = "json", file_rows: int = 100_000,
    max_folders: int = 1_000, folder_scans: int = 5_000,
) -> None:
    """One report per scan: findings below ``path``/findings and heads (metrics and counts) below ``path``/heads.

    Up to ``max_folders`` scans have a folder ``scan_id=...`` each.  More scans, whose folders a file system would take longer to make
    than all else, share folders ``scan_group=...`` of about ``folder_scans`` scans: a report is the run of its scan's rows there, and
    its head lies in the folder of the same name.  A scan's findings are in report order within a file and from file to file by name.
    The rows are dealt by ranges of (folder, scan, order), so many small scans share a task and a large one is cut into several, each
    file of ``file_rows`` rows at most.  ``fmt`` is json or csv; heads are JSON always.
    """
    with scratch(findings.sparkSession):
        heads = materialize(info.join(summary, "scan_id"))
    scans = heads.select("scan_id").distinct().count()
    folder, groups = "scan_id", {}
    if scans > max_folders:
        folder = "scan_group"
        groups = {folder: F.pmod(F.xxhash64("scan_id"), F.lit(math.ceil(scans / folder_scans))).cast("int")}
    order = [*groups, "scan_id", *REPORT_ORDER]
    ordered = ranked_findings(findings).withColumns(groups).repartitionByRange(*order).sortWithinPartitions(*order).select(
        *groups, "scan_id", *FIELDS
    )
    options = {"json": {"ignoreNullFields": "false"}, "csv": _CSV}[fmt]
    ordered.write.mode("overwrite").partitionBy(folder).option("maxRecordsPerFile", file_rows).options(**options).format(fmt).save(f"{path}/findings")
    order = [*groups, "scan_id"]
    heads = heads.withColumns(groups).repartitionByRange(*order).sortWithinPartitions(*order)
    heads.write.mode("overwrite").partitionBy(folder).options(ignoreNullFields="false").json(f"{path}/heads")


def read_scan_reports(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The findings of all reports that ``write_scan_reports`` wrote."""
    options = {"json": {}, "csv": _CSV | {"multiLine": "true"}}[fmt]
    found = spark.read.schema(schemas.FINDINGS).options(**options).format(fmt).load(f"{path}/findings").select(*schemas.FINDINGS.names)
    # A blank in a CSV file is an empty text; only the line may be missing.
    blank = {} if fmt == "json" else {c: F.coalesce(c, F.lit("")) for c in FIELDS if c != "line_number"}
    return found.withColumns(blank)


def write_findings_table(findings: DataFrame, path: str) -> None:
    """Findings as a table partitioned by severity, unsorted."""
    findings.write.mode("overwrite").partitionBy("severity").parquet(path)


def finding_rows_sink(path: str, query_id: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes findings-table rows.

    Every batch of a query owns one folder and overwrites it, so a batch that is repeated after a
    failure leaves no doubles.  ``query_id`` must stay over restarts and be another one for another
    checkpoint, whose batch numbers begin again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = finding_rows(batch)
        rows.write.mode("overwrite").format(fmt).save(f"{path}/query_id={query_id}/batch_id={batch_id}")

    return write


def append_sink(
    append: Callable[[DataFrame], None], read: Callable[[SparkSession], DataFrame], log_path: str, query_id: str,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends findings-table rows to any store, once each.

    For stores whose rows cannot be overwritten by folder: ``append`` adds rows, ``read`` returns the store's.  A log below ``log_path``
    has a folder for each batch that began and one for each that is done, with the number of rows of every scan.  A batch that is
    done is not written again.  One that began and is not done is compared with the store, and only the rows that are not there
    are appended, so a sink that fails half way may be tried again.  Rows carry query_id, batch_id and row_key, a hash of the
    row and of its number among equal ones.
    """
    columns = ["scan_id", "severity", "type", "title", "description", "location", "raw_data"]
    logged = T.StructType([T.StructField("scan_id", T.StringType()), T.StructField("n", T.LongType())])

    def folder(phase: str, batch_id: int) -> str:
        return f"{log_path}/{phase}/query_id={query_id}/batch_id={batch_id}"

    def exists(spark: SparkSession, path: str) -> bool:
        try:
            return not spark.read.schema(logged).parquet(path).isEmpty()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if exists(spark, folder("done", batch_id)):
            return
        counted = finding_rows(batch).groupBy(*columns).agg(F.count("*").alias("__n"))
        rows = counted.select(*columns, F.explode(F.sequence(F.lit(1), "__n")).alias("__copy")).select(
            *columns, F.lit(query_id).alias("query_id"), F.lit(batch_id).cast("long").alias("batch_id"),
            F.sha2(F.to_json(F.struct(*columns, "__copy")), 256).alias("row_key"),
        )
        if exists(spark, folder("begun", batch_id)):
            there = read(spark).filter((F.col("query_id") == query_id) & (F.col("batch_id") == batch_id)).select("row_key")
            rows = rows.join(there, "row_key", "left_anti").select(*columns, "query_id", "batch_id", "row_key")
        # A row even if the batch is empty: it says that the batch began.
        mark = spark.createDataFrame([(None, 0)], logged)
        mark.write.mode("overwrite").parquet(folder("begun", batch_id))
        append(rows)
        sizes = finding_rows(batch).groupBy("scan_id").agg(F.count("*").alias("n")).unionByName(mark)
        sizes.write.mode("overwrite").parquet(folder("done", batch_id))

    return write
