"""Passages that repeat across documents, by sparse suffix arrays.

A suffix array of every position is too much; only suffixes at minimiser
positions are retained: in each run of ``least // 2`` words the place where the
hashed ``gram`` words are smallest. Content alone selects them, so a passage of
``least`` words that two documents share has a retained suffix in both, at the
same place of the passage and with at least ``reach`` words of it to the right.

1. Texts that are equal word for word count once; each of them is repeated whole.
2. Suffixes are ordered by a key of their first ``reach`` words; equal neighbours
   from different texts are matches, all others go.
3. Matches are extended to the left and right: every run of ``least`` words around
   a matched suffix is compared with those of the other texts, and the runs that
   occur elsewhere are joined to maximal spans.

This finds exactly the words that lie in some run of ``least`` words which occurs
in two documents. Neighbours are first compared within a task: of a key that
several of its texts have, the task knows all it needs and sends on one row, so a
passage that a third of all documents share is one row per task. Keys and texts
are named by 64-bit hashes.

Defined results: words are runs without white space, A-Z lower-cased; null, empty
and shorter texts have no spans; rows equal in id and text are one document; null
ids are told apart by their text; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm import words
from veilframe.sources.workdir import materialise

_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


@dataclass(frozen=True)
class Lengths:
    """A passage's least length, and the words that a minimiser hashes."""

    least: int = 50
    gram: int = 8

    @property
    def window(self) -> int:
        """Grams of which one is retained."""
        return max(1, self.least // 2 - self.gram + 1)

    @property
    def reach(self) -> int:
        return self.least - self.window + 1


def runs(doc: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, from running sums."""
    n = len(doc)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = np.full(n, _STEP, dtype=np.uint64), np.full(n, _BACK, dtype=np.uint64)
    up[0] = down[0] = 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(doc * np.cumprod(up), out=sums[1:])
    return words.mixed((sums[size:] - sums[:-size]) * np.cumprod(down)[: n - size + 1])


def retained(doc: np.ndarray, lengths: Lengths) -> np.ndarray:
    """Minimiser positions that have ``reach`` words to their right."""
    if len(doc) < lengths.least:
        return np.zeros(0, dtype=np.int64)
    grams = runs(doc, lengths.gram)
    windows = np.lib.stride_tricks.sliding_window_view(grams, lengths.window)
    at = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    return at[at + lengths.reach <= len(doc)]


def _content(doc: np.ndarray) -> int:
    """Names a sequence of words."""
    return int(runs(doc, len(doc)).view(np.int64)[0]) if len(doc) else 0


def _task_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id, th) -> (id, th, content, n)."""
    for batch in words.slices(batches, "text"):
        found = words.words(batch.column(0), words.BLANKS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2),
             pa.array([_content(found.of(i)) for i in range(len(found))], pa.int64()),
             pa.array(np.diff(found.offsets))],
            names=["id", "th", "content", "n"],
        )


_ROWS = "key long, content long, start int, other long"
_FLUSH = 2_000_000  # rows compared at a time in a task


def _compared(key, content, start) -> pa.RecordBatch:
    """Compare rows by key: ``other`` is set where the task itself has a match.

    Of a key with a match one row goes on without ``other``, to meet other tasks'.
    """
    order = np.lexsort((start, content, key))
    key, content, start = key[order], content[order], start[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    last = np.append(edge[1:], len(key)) - 1
    low, high = content[edge], content[last]
    size = last - edge + 1
    several = np.repeat(low != high, size)
    other = np.where(content == np.repeat(low, size), np.repeat(high, size), np.repeat(low, size))
    on = np.zeros(len(key), dtype=bool)
    on[edge] = True  # the first of each key; all rows of a key within one text
    rows = np.concatenate([np.flatnonzero(several), np.flatnonzero(on | ~several)])
    known = np.concatenate([np.ones(several.sum(), dtype=bool), np.zeros((on | ~several).sum(), dtype=bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array(key[rows]), pa.array(content[rows]), pa.array(start[rows].astype(np.int32)),
         pa.array(other[rows], mask=~known)],
        names=["key", "content", "start", "other"],
    )


def _in_flushes(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= _FLUSH:
            yield _compared(*map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield _compared(*map(np.concatenate, zip(*held, strict=True)))


def _task_suffixes(lengths: Lengths):
    """(text) -> rows of retained suffixes, once per text and key."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        seen: set[int] = set()
        for batch in words.slices(batches, "text"):
            found = words.words(batch.column(0), words.BLANKS)
            for i in range(len(found)):
                doc = found.of(i)
                places = retained(doc, lengths)
                if len(places) and (content := _content(doc)) not in seen:
                    seen.add(content)
                    key, first = np.unique(runs(doc, lengths.reach)[places].view(np.int64), return_index=True)
                    yield key, np.full(len(key), content), places[first]

    return lambda batches: _in_flushes(parts(batches))


def _task_extend(lengths: Lengths):
    """(text, keys) -> rows of the runs around matched suffixes."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in words.slices(batches, "text"):
            found = words.words(batch.column(0), words.BLANKS)
            for i in range(len(found)):
                doc = found.of(i)
                places = retained(doc, lengths)
                keys = runs(doc, lengths.reach)[places].view(np.int64)
                near = places[np.isin(keys, np.asarray(batch.column(1)[i].values))]
                first = np.unique((near[:, None] - np.arange(lengths.window)).ravel())
                first = first[(first >= 0) & (first + lengths.least <= len(doc))]
                yield runs(doc, lengths.least)[first].view(np.int64), np.full(len(first), _content(doc)), first

    return lambda batches: _in_flushes(parts(batches))


def _matched(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs in two texts or more, with one other text."""
    own = Window.partitionBy("key")
    met = (
        rows.filter(F.col("other").isNull()).drop("other")
        .withColumn("low", F.min("content").over(own))
        .withColumn("high", F.max("content").over(own))
        .filter("low <> high")
        .withColumn("other", F.when(F.col("content") == F.col("low"), F.col("high")).otherwise(F.col("low")))
        .drop("low", "high")
    )
    return rows.filter(F.col("other").isNotNull()).unionByName(met)


def _joined(runs_of: str, least: int):
    """Maximal spans of a sorted array of runs (start, other)."""
    kind = "struct<start:int, end:int, other:bigint>"
    none = F.struct(
        F.expr(f"cast(array() as array<{kind}>)").alias("done"),
        F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(None).cast("bigint").alias("other"),
    )
    last = lambda acc: F.array(F.struct(acc["start"], acc["end"], acc["other"]).cast(kind))
    closed = lambda acc: F.when(acc["start"] < 0, acc["done"]).otherwise(
        F.concat(acc["done"], last(acc))
    )

    def add(acc, run):
        on = run["start"] <= acc["end"]
        return F.struct(
            F.when(on, acc["done"]).otherwise(closed(acc)).alias("done"),
            F.when(on, acc["start"]).otherwise(run["start"]).alias("start"),
            (run["start"] + least).alias("end"),
            F.when(on, acc["other"]).otherwise(run["other"]).alias("other"),
        )

    return F.aggregate(runs_of, none, add, closed)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Lengths = Lengths()
) -> DataFrame:
    """One row per document and maximal span: id, ``start_word``, ``end_word``
    (exclusive), ``n_words``, ``other`` (the smallest id of another text with the
    span's beginning, or of a copy)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(text.alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("th"))
    contents = materialise(
        source.mapInArrow(_task_contents, f"id {id_type}, th long, content long, n long"), "contents"
    )
    suffixes = materialise(
        source.select("text").mapInArrow(_task_suffixes(lengths), _ROWS), "suffixes"
    )
    keys = _matched(suffixes).groupBy("content").agg(F.collect_set("key").alias("keys"))
    row = F.struct(F.col("id").isNull().alias("none"), "id")
    by_content = contents.filter(F.col("n") >= lengths.least).groupBy("content").agg(
        F.min(F.struct("id", "th")).alias("one"), F.min(row).alias("low"), F.max(row).alias("high")
    )
    chosen = materialise(
        by_content.join(keys, "content").select(F.col("one.id").alias("cid"), F.col("one.th").alias("cth"), "keys"),
        "chosen",
    )
    texts = source.join(
        chosen, (F.col("th") == F.col("cth")) & F.col("id").eqNullSafe(F.col("cid"))
    ).dropDuplicates(["cid", "cth"])
    around = materialise(texts.select("text", "keys").mapInArrow(_task_extend(lengths), _ROWS), "runs")
    spans = (
        _matched(around).groupBy("content")
        .agg(F.array_sort(F.collect_set(F.struct("start", "other"))).alias("runs"))
        .select("content", F.explode(_joined("runs", lengths.least)).alias("span"))
        .select("content", "span.*")
    )
    names = by_content.select("content", F.col("low.id").alias("least"))
    spans = spans.join(
        names.withColumnsRenamed({"content": "other", "least": "other_id"}), "other", "left"
    ).select("content", "start", "end", "other_id")
    copied = by_content.filter(F.col("low") != F.col("high")).select(
        "content", F.col("low").alias("low"), F.col("high").alias("high")
    )
    # a text with copies is repeated as a whole
    marked = contents.filter(F.col("n") >= lengths.least).join(copied, "content", "left").distinct()
    whole = marked.filter(F.col("low").isNotNull()).select(
        "id", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"),
        F.when(F.col("id").eqNullSafe(F.col("low.id")), F.col("high.id")).otherwise(F.col("low.id")).alias("other_id"),
    )
    partly = marked.filter(F.col("low").isNull()).join(spans, "content").select("id", "start", "end", "other_id")
    return whole.unionByName(partly).select(
        F.col("id").alias(id_col),
        F.col("start").cast("long").alias("start_word"),
        F.col("end").cast("long").alias("end_word"),
        (F.col("end") - F.col("start")).cast("long").alias("n_words"),
        F.col("other_id").alias("other"),
    )
