"""Term lists that change while scans run, and long term lists.

The list is an append-only log of ``add`` and ``clear`` records, so a reader
never meets a half-written list and an update never overwrites what it reads.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import ScanConfig
from veilframe.functions.spans import SPANS_TYPE, empty
from veilframe.operators.detect import clean_terms, scan
from veilframe.operators.term_index import BUCKET, TermFilter, TermIndex, folded, span_arrays
from veilframe.sources.workdir import materialise

TERM_LOG_SCHEMA = "version bigint, action string, term string"


def _append(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, TERM_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TERM_LOG_SCHEMA).parquet(path)


def create_list(spark: SparkSession, path: str, terms: Iterable[str] = ()) -> None:
    _append(spark, path, [(0, "clear", None)] + [(1, "add", t) for t in clean_terms(terms)])


def _next_version(spark: SparkSession, path: str) -> int:
    return (_log(spark, path).agg(F.max("version").alias("v")).first()["v"] or 0) + 1


def add_terms(spark: SparkSession, path: str, terms: Iterable[str]) -> None:
    version = _next_version(spark, path)
    _append(spark, path, [(version, "add", t) for t in clean_terms(terms)])


def clear_terms(spark: SparkSession, path: str) -> None:
    _append(spark, path, [(_next_version(spark, path), "clear", None)])


def current_terms(log: DataFrame) -> DataFrame:
    """Distinct lower-cased terms added after the last clear."""
    last = log.filter(F.col("action") == "clear").agg(F.max("version").alias("_cleared"))
    return (
        log.filter(F.col("action") == "add")
        .join(F.broadcast(last), F.col("version") > F.coalesce("_cleared", F.lit(-1)))
        .select(F.lower("term").alias("term"))
        .distinct()
    )


def list_terms(spark: SparkSession, path: str) -> DataFrame:
    return current_terms(_log(spark, path))


#: Bounds of a term list whose index is sent to the workers.
BLOCK_TERMS, BLOCK_CHARS = 500_000, 8_000_000


def _index(spark: SparkSession, listed: DataFrame):
    """The index of a list of bounded size, broadcast."""
    return spark.sparkContext.broadcast(TermIndex.of(r["term"] for r in listed.collect()))


def _folded(listed: DataFrame) -> DataFrame:
    """The distinct terms as they are compared."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = ["".join(map(chr, folded(t).tolist())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(plain, pa.string())], names=["term"])

    return listed.mapInArrow(fold, "term string").distinct()


def _filter(spark: SparkSession, terms: DataFrame, n: int):
    """The bit table of a list of any length, broadcast; its size is bounded."""
    size = TermFilter.size_for(n)
    parts = (
        terms.mapInArrow(lambda batches: TermFilter.buckets(batches, size), "bucket bigint, bits binary")
        .groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    bits = np.zeros(1 << (size - 3), dtype=np.uint8)
    for part in parts.toLocalIterator():
        at = part["bucket"] * (BUCKET >> 3)
        bits[at : at + (BUCKET >> 3)] = np.frombuffer(part["bits"], np.uint8)
    lengths = sorted(r[0] for r in terms.select(F.length("term")).distinct().collect())
    return spark.sparkContext.broadcast(TermFilter(tuple(lengths), size, bits))


def _candidates(plain: DataFrame, shared) -> DataFrame:
    """``_key, _digest, term, start, end, value`` of what may be a term: a narrow pass."""
    key = plain.schema["_key"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, found in shared.value.candidates(batches, "_text"):
            term, start, end, value = zip(*found, strict=True) if found else ((),) * 4
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(term, pa.string()),
                 pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(value, pa.string())],
                names=["_key", "_digest", "term", "start", "end", "value"],
            )

    return plain.mapInArrow(
        find, f"_key {key}, _digest bigint, term string, start int, end int, value string"
    )


def _with_column(df: DataFrame, text: str, out: str, shared) -> DataFrame:
    """The rows with the spans of one block's terms: a narrow pass, nothing is shuffled."""
    rows = df.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T._parse_datatype_string(SPANS_TYPE))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch, spans in span_arrays(shared.value, batches, text, "blocklist", "blocklist"):
            names = names or [*batch.schema.names, out]
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=names)

    return rows.mapInArrow(find, schema)


def term_spans(
    df: DataFrame, key: str, text: str, terms: DataFrame, out: str = "spans",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """Add the spans of a term list of any length, overlaps included, the longest term first.

    ``terms`` has a column ``term``; ``key`` names a row. A list of up to half a
    million terms is searched for where the texts are, by an index, in Arrow batches, and no
    text is shuffled. A longer one takes one pass over the texts as well: a bit table of
    bounded size lets through what may be a term, a join with the list tells what is, and only
    that is gathered, by key, and meets the texts in one join. Memory is the index, or
    the table (128 MB at most), and a few million characters per worker.
    """
    spark = df.sparkSession
    listed = terms.select("term").filter("term <> ''").distinct()
    n, chars = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n == 0:
        return df.withColumn(out, empty())
    if n <= block_terms and chars <= BLOCK_CHARS:
        return _with_column(df, text, out, _index(spark, listed))
    known = materialise(_folded(listed), "terms")
    digest = F.xxhash64(F.col(text))
    plain = df.select(F.col(key).alias("_key"), digest.alias("_digest"), F.col(text).alias("_text"))
    hits = _candidates(plain, _filter(spark, known, n)).join(known, "term", "left_semi")
    # the longest first; rows that are equal find the same
    place = F.struct((F.col("start") - F.col("end")).alias("n"), "term", "start", "end", "value")
    span = lambda p: F.struct(
        F.lit("blocklist"), p["start"], p["end"], p["value"], F.lit(1.0), F.lit("blocklist")
    )
    merged = hits.groupBy("_key", "_digest").agg(
        F.transform(F.array_sort(F.collect_set(place)), span).cast(SPANS_TYPE).alias("_spans")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & digest.eqNullSafe(F.col("_digest"))
    rows = df.drop(out).join(merged, same, "left")
    return rows.withColumn(out, F.coalesce("_spans", empty())).drop("_key", "_digest", "_spans")


def scan_with_terms(
    df: DataFrame, key: str, text: str, terms: DataFrame, cfg: ScanConfig, out: str = "spans"
) -> DataFrame:
    """``scan`` with a term list of any length, after all other detectors."""
    rows = term_spans(df, key, text, terms, "_listed")
    both = dataclasses.replace(cfg, detectors=(*cfg.detectors, Given("blocklist", "_listed")))
    return scan(rows, text, both, out).drop("_listed")


class Given:
    """Spans that a column of the table already holds."""

    glue = None
    on_rows = True

    def __init__(self, name: str, column: str) -> None:
        self.name, self.column = name, column

    def spans(self, text: Column) -> Column:
        return F.col(self.column)
