"""Counters and live term lists over streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.operators.detect import explode_spans
from veilframe.operators.terms import list_terms, scan_with_terms


def running_counts(
    events: DataFrame,
    ts: str,
    labels: Sequence[str],
    width: str = "1 hour",
    late: str = "1 hour",
) -> DataFrame:
    """Events per label set and time window; ``late`` bounds state and lateness."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width), *labels)
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("window_start"), *labels, "requests")
    )


def scan_with_live_terms(
    texts: DataFrame,
    spark: SparkSession,
    term_path: str,
    key: str,
    text: str,
    base: ScanConfig,
    write: Callable[[DataFrame, int], None],
):
    """Scan a stream with the term list as it stands at each micro-batch.

    Returns a writer; ``write`` receives one row per span.
    """
    def run(batch: DataFrame, epoch: int) -> None:
        terms = list_terms(spark, term_path)
        write(explode_spans(scan_with_terms(batch, key, text, terms, base), key), epoch)

    return texts.writeStream.foreachBatch(run)
