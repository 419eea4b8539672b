"""Batch and streaming sources. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.sources.workdir import materialise

BODY_SCHEMA = "request_id string, provider string, body string"
_DATA = "data: "
FILES_A_TASK = 512


def read_bodies(
    spark: SparkSession, path: str, fmt: str = "json", schema: str = BODY_SCHEMA, stream: bool = False
) -> DataFrame:
    """Request or response bodies, one record per row (JSON lines or Parquet)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).load(path)


def reject_unreadable(bodies: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Rows with a body, and the rejected rest with a reason."""
    lost = bodies.filter(F.col(body).isNull()).withColumn("reason", F.lit("unreadable body"))
    return bodies.filter(F.col(body).isNotNull()), lost


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with their bytes: ``path, content, length``.

    Spark counts a small file as 4 MB and gives a task a few of them; here it takes up to
    ``FILES_A_TASK``, and no more bytes on average than a split has.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    found = reader.load(path)
    listed = found._jdf.queryExecution().analyzed().relation().location()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = -(-listed.allFiles().size() // FILES_A_TASK) + -(-listed.sizeInBytes() // split)
    rows = found.select("path", "content", "length")
    return rows.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism))


def sse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Mark event-stream lines: ``is_data``, and ``data`` without its prefix."""
    is_data = F.startswith(F.col(line), F.lit(_DATA))
    return lines.withColumn("is_data", is_data).withColumn(
        "data", F.when(is_data, F.substring(line, F.lit(len(_DATA) + 1), F.length(line)))
    )


def read_sse(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Event-stream text, one row per line; lines other than data pass through."""
    reader = spark.readStream if stream else spark.read
    return sse_lines(reader.format("text").load(path))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files below a folder with their places: ``file, line, value``.

    A large file is read in splits by many tasks. Within a split, lines come in
    order; what lies before a split is the sum of the earlier splits' line counts.
    A line belongs to the split in which it begins. Lines end with a line feed, and
    a carriage return before it goes; an empty file has no lines. The lines are
    stored once, as a second reading could be split in another way.
    """
    lines = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", True).load(path)
    placed = materialise(
        lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_at"),
            F.regexp_replace("value", "\r\\z", "").alias("value"),
        ),
        "lines",
    )
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("file", "_split").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines")
    ).select("file", "_split", "_first", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(splits, ["file", "_split"]).select(
        "file", "_split", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"), "value"
    )


def read_sse_streams(
    spark: SparkSession, path: str, stream: bool = False, header: str | None = None
) -> DataFrame:
    """Event-stream files line by line, in order: ``stream_id, seq`` and ``sse_lines``.

    A file is one stream, unless lines that begin with ``header`` are given as the
    starts of streams: then ``stream_id`` has the number of the first line behind the
    file's name, and a column ``header`` holds that line (null before the first).
    Batch reading splits large files (``ordered_lines``). As a stream
    (``stream=True``, without ``header``) a file is read as a whole.
    """
    if stream:
        if header is not None:
            raise ValueError("streams within files are told in batch reading only")
        whole = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
        body = F.regexp_replace("value", "\r?\n\\z", "")
        return sse_lines(
            whole.load(path).filter("value <> ''").select(
                F.col("_metadata.file_path").alias("stream_id"),
                F.posexplode(F.split(body, "\r?\n", -1)).alias("seq", "value"),
            )
        )
    lines = ordered_lines(spark, path)
    if header is None:
        return sse_lines(
            lines.select(F.col("file").alias("stream_id"), F.col("line").cast("int").alias("seq"), "value")
        )
    return sse_lines(_streams_within(lines, header))


def _streams_within(lines: DataFrame, header: str) -> DataFrame:
    """Each line with the last header at or before it: inside its split, else of an earlier one."""
    of_split = Window.partitionBy("file", "_split").orderBy("line")
    before = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.startswith("value", F.lit(header)), F.struct("line", "value"))
    marked = lines.withColumn("_head", begins)
    carried = marked.groupBy("file", "_split").agg(F.max("_head").alias("_head")).select(
        "file", "_split", F.max("_head").over(before).alias("_carried")
    )
    head = F.coalesce(F.max("_head").over(of_split), F.col("_carried"))
    told = marked.join(carried, ["file", "_split"]).withColumn("_head", head)
    first = F.coalesce(F.col("_head.line"), F.lit(0))
    return told.select(
        F.concat("file", F.lit("#"), first).alias("stream_id"),
        F.col("_head.value").alias("header"),
        (F.col("line") - first).alias("seq"),
        "value",
    )


def sse_text(lines: DataFrame, data: str, line: str = "value") -> DataFrame:
    """Inverse of ``sse_lines``: the outgoing lines."""
    return lines.select(
        F.when(F.col("is_data"), F.concat(F.lit(_DATA), F.col(data))).otherwise(F.col(line)).alias("value")
    )


def term_frame(spark: SparkSession, terms: Iterable[str]) -> DataFrame:
    """A configured list as a one-column table."""
    return spark.createDataFrame([(t,) for t in terms], "term string")
