"""Running totals over ordered rows without one task per key.

A window over one key runs in one task. Where a key may hold a large share of
all rows, the rows are cut into blocks along their order (a second of time, some
thousand sequence numbers); a window runs inside each (key, block), and the block
totals supply what came before, in two levels: within a group of blocks, and
over the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, _GROUP = "_block", "_group"
BLOCKS_PER_GROUP = 4096
ROWS_PER_SEQUENCE_BLOCK = 10_000


def time_blocks(df: DataFrame, ts: str) -> DataFrame:
    """One block per second; needs no look at the data."""
    return df.withColumn(BLOCK, F.floor(F.unix_micros(ts) / 1_000_000).cast("bigint"))


def sequence_blocks(df: DataFrame, seq: str, rows: int = ROWS_PER_SEQUENCE_BLOCK) -> DataFrame:
    """Blocks for a distinct integer order: no block exceeds ``rows`` rows per key."""
    return df.withColumn(BLOCK, F.floor(F.col(seq) / rows).cast("bigint"))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` up to and including each row; ``df`` carries ``_block``.

    The block must not decrease along ``order``. The join back is on the columns
    the rows are already partitioned by, so the rows are shuffled once.
    """
    keys = list(keys)
    rows = df.withColumn("_v", value)
    inside = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = rows.groupBy(*keys, BLOCK).agg(F.sum("_v").alias("_sum")).withColumn(
        _GROUP, F.floor(F.col(BLOCK) / BLOCKS_PER_GROUP).cast("bigint")
    )
    # NULL blocks come first, as NULL orders do
    earlier = lambda of, by: (
        Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    )
    groups = (
        totals.groupBy(*keys, _GROUP).agg(F.sum("_sum").alias("_all"))
        .withColumn("_far", F.coalesce(F.sum("_all").over(earlier(keys, _GROUP)), F.lit(0)))
        .drop("_all")
    )
    near = F.coalesce(F.sum("_sum").over(earlier([*keys, _GROUP], BLOCK)), F.lit(0))
    carry = null_safe_join(totals.withColumn("_near", near), groups, [*keys, _GROUP]).select(
        *keys, BLOCK, (F.col("_near") + F.col("_far")).alias("_carry")
    )
    rows = rows.withColumn("_in", F.sum("_v").over(inside))
    return (
        null_safe_join(rows, carry, [*keys, BLOCK])
        .withColumn(out, F.col("_in") + F.col("_carry"))
        .drop("_v", "_in", "_carry")
    )


def null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join in which NULL keys meet; the left key columns are kept."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])
