"""Rows in one order over all partitions, and sums along it, without a window per key.

``in_order`` range-partitions and sorts rows once and stores them with the number
of their partition and, per group of equal keys, their number and running size
within that partition. A group can reach over many partitions; ``carried`` gives
what lies before it in earlier ones, one row per partition that a group enters
from an earlier one, so a group with a third of all rows is spread like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilframe.sources.workdir import materialise

PART, NTH, BEFORE = "__part", "__nth", "__before"
_BAND = 512


def _same_as_last(values: pa.Array, last) -> np.ndarray:
    """Whether each value equals the one before it (``last`` before the first); nulls are equal."""
    n = len(values)
    codes = values.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    same = np.zeros(n, dtype=bool)
    same[1:] = codes[1:] == codes[:-1]
    if n and last is not None:
        same[0] = values[0].as_py() == last[0]
    return same


def _numbered(batches: Iterator[pa.RecordBatch], key: str, size: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted batches with partition, number and running size within the run of equal keys."""
    part = TaskContext.get().partitionId()
    last, nth, before = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        sizes = batch.column(batch.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
        same = _same_as_last(keys, last)
        heads = np.flatnonzero(~same)
        run = np.zeros(n, dtype=np.int64)
        if len(heads):
            run[heads[0]:] = np.repeat(heads, np.diff(np.append(heads, n)))
        sums = np.concatenate([[0], np.cumsum(sizes)])
        numbers, running = np.arange(n) - run, sums[:-1] - sums[run]
        first = heads[0] if len(heads) else n  # rows that go on with the last batch's run
        numbers[:first] += nth
        running[:first] += before
        last, nth, before = (keys[n - 1].as_py(),), int(numbers[-1]) + 1, int(running[-1] + sizes[-1])
        extra = [pa.array(np.full(n, part, dtype=np.int32)), pa.array(numbers), pa.array(running)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *extra], schema=schema)


def in_order(rows: DataFrame, key: str, order: Sequence[Column], size: str, name: str) -> DataFrame:
    """The rows, sorted by ``order`` (which starts with ``key``), stored.

    Adds ``__part``, and ``__nth`` and ``__before``: rows and sum of ``size`` before
    a row among those with its key in its partition.
    """
    schema = T.StructType(
        [
            *rows.schema.fields,
            T.StructField(PART, T.IntegerType()),
            T.StructField(NTH, T.LongType()),
            T.StructField(BEFORE, T.LongType()),
        ]
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from _numbered(batches, key, size, to_arrow_schema(schema))

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(sorted_rows.mapInArrow(number, schema), name)


def carried(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Per key and partition that the key reaches from an earlier one: rows and size before."""
    per_part = rows.groupBy(key, PART).agg(
        F.count(F.lit(1)).alias("__rows"), F.sum(size).alias("__size")
    )
    earlier = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_part.withColumn("__rows_before", F.sum("__rows").over(earlier))
        .withColumn("__size_before", F.sum("__size").over(earlier))
        .filter(F.col("__rows_before").isNotNull())
        .select(F.col(key).alias("__key"), F.col(PART).alias("__in"), "__rows_before", "__size_before")
    )


def placed(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of ``in_order`` with ``__nth`` and ``__before`` counted over all partitions."""
    before = carried(rows, key, size)
    return (
        rows.join(before, rows[key].eqNullSafe(before["__key"]) & (rows[PART] == before["__in"]), "left")
        .withColumn(NTH, F.col(NTH) + F.coalesce("__rows_before", F.lit(0)))
        .withColumn(BEFORE, F.col(BEFORE) + F.coalesce("__size_before", F.lit(0)))
        .drop("__key", "__in", "__rows_before", "__size_before")
    )


def part_starts(totals: DataFrame, part: str, total: str) -> DataFrame:
    """Per partition number the sum of ``total`` over all lower ones (``__start``), in two levels."""
    band = F.floor(F.col(part) / _BAND).cast("long")
    sums = totals.groupBy(part).agg(F.sum(total).alias("__sum")).withColumn("__band", band)
    in_band = Window.partitionBy("__band").orderBy(part)
    over_bands = Window.partitionBy(F.lit(0)).orderBy("__band")
    bands = sums.groupBy("__band").agg(F.sum("__sum").alias("__of_band"))
    bands = bands.select("__band", (F.sum("__of_band").over(over_bands) - F.col("__of_band")).alias("__band_start"))
    return sums.join(bands, "__band").select(
        part, (F.col("__band_start") + F.sum("__sum").over(in_band) - F.col("__sum")).alias("__start")
    )
