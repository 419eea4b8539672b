"""Totals along an order that no single task holds, in DataFrame functions only.

Rows are dealt into 65,536 cells per key by the leading hex digits of a hash;
cells belong to 256 bands. Offsets of cells come from the (small) table of cell
totals, so the largest window holds one cell, one band's cells or one key's
bands. A key with a third of all rows is spread over all its cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CELL, BAND = "__cell", "__band"
_CELL_DIGITS, _BAND_DIGITS = 4, 2


def order_hash(seed: str, doc_id: Column, text: Column) -> Column:
    """Hex digits that order rows the same way on every run.

    The id decides; rows without an id are spread by their text.
    """
    identity = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)), F.lit(""))
    return F.md5(F.concat(F.lit(seed + "|"), identity))


def with_cells(rows: DataFrame, hashed: str) -> DataFrame:
    return rows.withColumn(CELL, F.substring(hashed, 1, _CELL_DIGITS))


def cell_totals(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and cell with the sum of ``value``; needs ``with_cells``."""
    return (
        rows.groupBy(*keys, CELL)
        .agg(F.sum(value).alias("__total"))
        .withColumn(BAND, F.substring(CELL, 1, _BAND_DIGITS))
    )


def cell_offsets(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and cell: the sum over the cells before it (``__offset``)."""
    in_band = Window.partitionBy(*keys, BAND).orderBy(CELL)
    in_key = Window.partitionBy(*keys).orderBy(BAND)
    bands = (
        totals.groupBy(*keys, BAND)
        .agg(F.sum("__total").alias("__band_total"))
        .withColumn(
            "__band_offset",
            F.sum("__band_total").over(in_key.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__band_total"),
        )
        .drop("__band_total")
    )
    return (
        totals.withColumn(
            "__in_band",
            F.sum("__total").over(in_band.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("__total"),
        )
        .join(bands, [*keys, BAND])
        .select(*keys, CELL, (F.col("__in_band") + F.col("__band_offset")).alias("__offset"))
    )


def sum_before(keys: Sequence[str], order: Sequence[str], value: str) -> Column:
    """Sum of ``value`` over the rows before this one, given the joined ``__offset``."""
    rows = Window.partitionBy(*keys, CELL).orderBy(*order)
    running = F.sum(value).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return F.col("__offset") + running - F.col(value)
