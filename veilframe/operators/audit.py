"""The audit table: one row per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.requests import caller

AUDIT_SCHEMA = (
    "request_id string, timestamp timestamp, user_id string, provider string, "
    "pii_detected int, pii_types array<string>, request_redacted string, "
    "status_code int, latency_ms bigint"
)


def audit_entries(redacted: DataFrame) -> DataFrame:
    """Audit rows from redacted requests; everything is already in the row.

    Expects ``request_id, ts, user_id, provider, spans, redacted_body,
    status_code, latency_ms``.
    """
    types = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["type"])))
    return redacted.select(
        "request_id",
        F.col("ts").alias("timestamp"),
        caller(F.col("user_id")).alias("user_id"),
        "provider",
        F.size("spans").alias("pii_detected"),
        types.alias("pii_types"),
        F.col("redacted_body").alias("request_redacted"),
        F.col("status_code").cast("int").alias("status_code"),
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
    )


def rfc3339(ts: str):
    """UTC time as text to the second, e.g. ``2024-01-01T00:00:07Z``."""
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(ts).cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
