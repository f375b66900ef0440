"""Explicit schemas of the input and output tables."""

from __future__ import annotations

from pyspark.sql import types as T

HEADER = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
])

TARGETS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("target_url", T.StringType()),
])

# url is the requested URL, status the one after redirects; headers keep order and repeats.
RESPONSES = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("body", T.StringType()),
    T.StructField("content_length", T.LongType()),
    T.StructField("fetch_error", T.StringType()),
    T.StructField("fetched_at", T.TimestampType()),
])

# origin has no port; status is NULL when the fetch failed.
ROBOTS_FILES = T.StructType([
    T.StructField("origin", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content", T.StringType()),
])

# One row per TXT chunk; a lookup without answer has no rows.
DNS_RECORDS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("rrtype", T.StringType()),
    T.StructField("rec_no", T.IntegerType()),
    T.StructField("chunk_no", T.IntegerType()),
    T.StructField("value", T.StringType()),
])

TLS_OBSERVATIONS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("tcp_ok", T.BooleanType()),
    T.StructField("handshake_ok", T.BooleanType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("not_after_epoch", T.LongType()),
    T.StructField("observed_epoch", T.LongType()),
    T.StructField("http_ok", T.BooleanType()),
    T.StructField("hsts", T.StringType()),
])

CT_ENTRIES = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("name_value", T.StringType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

SCAN_EVENTS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

FINDINGS = T.StructType([
    T.StructField("scan_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("finding_type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
])
