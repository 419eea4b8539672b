"""Batch and streaming sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def append_audit(entries: DataFrame, path: str) -> None:
    """Append audit rows, one JSON object per line."""
    entries.write.mode("append").json(path)


def audit_stream(entries: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append audit rows of a stream exactly once (the file sink keeps a log)."""
    return (
        entries.writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def write_redacted(redacted: DataFrame, path: str, keep: Sequence[str]) -> None:
    """Store the columns to ``keep`` of a redacted table.

    A list of what is safe, not of what to drop: a column nobody thought of
    stays out.
    """
    redacted.select(*keep).write.mode("error").parquet(path)


def write_files(rows: DataFrame, path: str, key: str, text: str) -> None:
    """A text file for each value of ``key``, named ``<key>=<value>``, with a line for each row.

    Rows are dealt to all tasks, whatever the splits of the table, and each task puts its
    files in place. Hadoop starts a process for each local folder or file it makes, so
    on a mounted folder (``file:``) Python opens them, in one folder a task. In other stores
    Spark writes them, in one folder a key.
    """
    spark = rows.sparkSession
    dealt = rows.select(key, F.coalesce(text, F.lit("")).alias("value")).repartition(key)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getScheme() != "file":
        writer = dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        return writer.partitionBy(key).text(path)
    os.makedirs(base := place.toUri().getPath())
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit(_NO_KEY)))
    named = dealt.sortWithinPartitions(key).select(name.alias("name"), F.col("value").cast("binary"))
    done = named.mapInArrow(lambda batches: _put_files(batches, base), "n long")
    done.write.format("noop").mode("overwrite").save()


_NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def _put_files(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    """Write lines in order of their files' names; a file appears when it is whole."""
    task = TaskContext.get()
    folder = f"{base}/part-{task.partitionId():05d}"
    partial = f"{folder}/.{task.taskAttemptId()}"
    os.makedirs(folder, exist_ok=True)
    out, now, n = None, None, 0
    for batch in batches:
        for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != now:
                n += _put(out, partial, folder, now)
                out, now = open(partial, "wb"), name
            out.write(value)
            out.write(b"\n")
    n += _put(out, partial, folder, now)
    yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def _put(out, partial: str, folder: str, name: str | None) -> int:
    if out is None:
        return 0
    out.close()
    os.replace(partial, f"{folder}/{quote(name, safe='=')}.txt")
    return 1


def write_metrics(counters: DataFrame, path: str) -> None:
    """Replace a counter table."""
    counters.write.mode("overwrite").parquet(path)


def write_vault(vault: DataFrame, path: str, scope_date: str | None = None) -> None:
    """Append vault rows, partitioned by day when a date column is given.

    Batches may overlap: equal values have equal tokens and ciphertexts, and
    reading takes a token once.
    """
    writer = vault.write.mode("append")
    (writer.partitionBy(scope_date) if scope_date else writer).parquet(path)


@dataclass(frozen=True)
class CounterTable:
    """Counters that add up over micro-batches, each batch counted once.

    ``schema`` names labels and counts (DDL), ``counts`` the columns that are summed;
    cumulative histogram buckets are counts too, their bound is a label. A batch is
    a folder named by its epoch, so a batch that is replayed replaces itself.
    ``compact`` sums the epochs up to one into one table; later replays of those are
    ignored. What a compaction has replaced stays until the next one, for readers
    under way. One table takes the epochs of one stream, and one writer at a time.
    """

    path: str
    schema: str
    counts: tuple[str, ...]

    def _numbers(self, spark: SparkSession, kind: str) -> list[int]:
        """The finished folders of a kind, by number."""
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = files.globStatus(jvm.org.apache.hadoop.fs.Path(base, "n=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in done)

    def _remove(self, spark: SparkSession, kind: str, numbers: list[int]) -> None:
        jvm = spark.sparkContext._jvm
        for n in numbers:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/n={n}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _sums(self, parts: DataFrame) -> DataFrame:
        labels = [c for c in parts.columns if c not in self.counts]
        summed = parts.groupBy(*labels).agg(*[F.sum(c).alias(c) for c in self.counts])
        return summed.select(*parts.columns)

    def add(self, batch: DataFrame, epoch: int) -> None:
        """Add a batch's counts; for ``foreachBatch``."""
        spark = batch.sparkSession
        if epoch > max(self._numbers(spark, "totals"), default=-1):
            names = spark.createDataFrame([], self.schema).columns
            self._sums(batch.select(*names)).write.mode("overwrite").parquet(f"{self.path}/epochs/n={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The totals of all epochs."""
        through = max(self._numbers(spark, "totals"), default=-1)
        parts = [f"{self.path}/epochs/n={n}" for n in self._numbers(spark, "epochs") if n > through]
        if through >= 0:
            parts.append(f"{self.path}/totals/n={through}")
        if not parts:
            return spark.createDataFrame([], self.schema)
        return self._sums(spark.read.schema(self.schema).parquet(*parts))

    def compact(self, spark: SparkSession, through: int) -> None:
        """Sum the epochs up to ``through``, which must all have been added."""
        totals = self._numbers(spark, "totals")
        last = max(totals, default=-1)
        if through <= last:
            return
        epochs = self._numbers(spark, "epochs")
        parts = [f"{self.path}/epochs/n={n}" for n in epochs if last < n <= through]
        if last >= 0:
            parts.append(f"{self.path}/totals/n={last}")
        if not parts:
            return
        done = self._sums(spark.read.schema(self.schema).parquet(*parts))
        done.write.mode("overwrite").parquet(f"{self.path}/totals/n={through}")
        self._remove(spark, "epochs", [n for n in epochs if n <= last])
        self._remove(spark, "totals", [n for n in totals if n < last])
