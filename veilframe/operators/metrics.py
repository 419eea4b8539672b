"""Counters and histograms. All are partial aggregations: hot labels are safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.config import LATENCY_BUCKETS_SECONDS


def detections_by_type(spans: DataFrame) -> DataFrame:
    """Number of spans per type and detector."""
    return spans.groupBy("type", "detector_name").agg(F.count(F.lit(1)).alias("detections"))


def detections_per_request(scanned: DataFrame, request: str, spans: str = "spans") -> DataFrame:
    """Number of spans per request, zero included."""
    return scanned.groupBy(request).agg(F.sum(F.size(spans)).alias("detections"))


def types_found(spans: DataFrame, *keys: str) -> DataFrame:
    """Sorted distinct types per group; duplicates collapse before the shuffle."""
    return spans.groupBy(*keys).agg(F.array_sort(F.collect_set("type")).alias("types"))


def requests_by(log: DataFrame, labels: Sequence[str] = ("method", "path", "status_code")) -> DataFrame:
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("requests"))


def injections_by_action(flagged: DataFrame) -> DataFrame:
    return (
        flagged.filter(F.col("action").isNotNull())
        .groupBy("action")
        .agg(F.count(F.lit(1)).alias("requests"))
    )


def latency_histogram(
    log: DataFrame,
    latency_ms: str = "latency_ms",
    labels: Sequence[str] = ("method", "path"),
    buckets: Sequence[float] = LATENCY_BUCKETS_SECONDS,
) -> DataFrame:
    """Cumulative bucket counts, one row per label set and upper bound in seconds.

    The last bound is infinity; ``sum_ms`` and ``n`` repeat per label set.
    """
    counts = [
        F.count_if(F.col(latency_ms) <= F.lit(b * 1000)).alias(f"_b{i}")
        for i, b in enumerate(buckets)
    ]
    wide = log.groupBy(*labels).agg(
        *counts, F.count(latency_ms).alias("n"), F.sum(latency_ms).alias("sum_ms")
    )
    rows = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(buckets)
    ]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("n").alias("cumulative")))
    return wide.select(*labels, "n", "sum_ms", F.inline(F.array(*rows)))
