"""Load over time: concurrency and failure runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.config import FAILURES_TO_TRIP, MAX_CONCURRENCY
from veilframe.operators.ordered import running_total, time_blocks


def concurrency(log: DataFrame, start: str, end: str, ident: str) -> DataFrame:
    """Open requests after every start and end: ``ident, ts, delta, active``.

    An interval is open from its start up to, not including, its end; at equal
    times ends count first.
    """
    edges = log.select(
        F.col(ident),
        F.inline(
            F.array(
                F.struct(F.col(start).alias("ts"), F.lit(1).alias("delta")),
                F.struct(F.col(end).alias("ts"), F.lit(-1).alias("delta")),
            )
        ),
    )
    blocked = time_blocks(edges, "ts")
    out = running_total(blocked, [], ["ts", "delta", ident], F.col("delta"), "active")
    return out.select(ident, "ts", "delta", "active")


def peak_concurrency(log: DataFrame, start: str, end: str, ident: str) -> DataFrame:
    return concurrency(log, start, end, ident).agg(F.max("active").alias("peak"))


def over_concurrency(
    log: DataFrame, start: str, end: str, ident: str, cap: int = MAX_CONCURRENCY
) -> DataFrame:
    """Requests that started while more than ``cap`` were open, themselves included."""
    return concurrency(log, start, end, ident).filter(
        (F.col("delta") > 0) & (F.col("active") > cap)
    ).select(ident, "ts", "active")


def failure_runs(
    log: DataFrame,
    key: str,
    ts: str,
    ident: str,
    failed: str,
    at_least: int = FAILURES_TO_TRIP,
) -> DataFrame:
    """Runs of consecutive failures per key: ``key, run_start, run_end, failures``.

    Failures of one run share the number of successes before them.
    """
    order: Sequence[str] = [ts, ident]
    rows = time_blocks(log.select(key, ts, ident, failed), ts)
    counted = running_total(
        rows, [key], order, F.when(F.col(failed), F.lit(0)).otherwise(F.lit(1)), "_successes"
    )
    runs = counted.filter(F.col(failed)).groupBy(key, "_successes").agg(
        F.min(ts).alias("run_start"),
        F.max(ts).alias("run_end"),
        F.count(F.lit(1)).alias("failures"),
    )
    return runs.filter(F.col("failures") >= at_least).drop("_successes")


def over_rate(
    log: DataFrame, caller: str, ts: str, ident: str, limit: int, seconds: int = 1
) -> DataFrame:
    """Every request with how many its caller made in the ``seconds`` up to it.

    Adds ``recent`` (itself included) and ``over``. A caller's requests are dealt
    to slots of that length, so a busy caller spreads over all tasks. Each counts
    from the start of the next slot too, until it is ``seconds`` old: a running sum
    of comings and goings, linear in the requests of a slot.
    """
    width = seconds * 1_000_000
    rows = log.withColumn("_us", F.unix_micros(ts))
    own = F.floor(F.col("_us") / width)
    goes = F.col("_us") + width
    dealt = rows.select(
        "*",
        F.explode(
            F.array(
                F.struct(own.alias("slot"), F.col("_us").alias("at"), F.lit(1).alias("delta"), F.lit(True).alias("own")),
                F.struct(
                    (own + 1).alias("slot"), goes.alias("at"),
                    F.when(goes.isNull(), 0).otherwise(-1).alias("delta"), F.lit(False).alias("own"),
                ),
            )
        ).alias("_at"),
    )
    slot = Window.partitionBy(caller, "_at.slot")
    so_far = slot.orderBy("_at.at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    carried = F.count(F.when(~F.col("_at.own"), 1)).over(slot)
    return (
        dealt.withColumn("recent", carried + F.sum("_at.delta").over(so_far))
        .filter("_at.own")
        .withColumn("over", F.col("recent") > limit)
        .drop("_us", "_at")
    )
