"""Benchmark decontamination with a positional inverted index of the corpus.

Test items are taken in blocks of about ``block_words`` words, so that what goes
to every task has a bound. Per block:

1. count how often the block's terms occur in the whole corpus;
2. choose the rarest two of the terms that occur, in every window of ``width`` item
   words (of the whole item if it is shorter); of equally rare ones the first. A window
   with a term that never occurs can be no phrase match, but a proximity match;
3. store the postings of these terms: (term, document, positions);
4. shift each posting by the term's place in the item and intersect: postings of
   one item that fall on one diagonal of one document are a candidate;
5. compare the candidates' words with the item's, run by run. A run of a window's
   length or more is an exact phrase match.

Proximity matches: at least two chosen places of an item meet on one diagonal of a document
(words replaced), or on two diagonals, one after the other and at most ``slack`` words apart
(words put in or left out between them), with more places than either has alone. ``judge``
counts an item as near where it has no phrase match.

Words are compared by 64-bit hashes. A frequent term's postings are spread by
document before they meet; the text of candidates only is read again.

Defined results: null and empty texts have no words; items without words match
nothing; a null item id counts as an empty one, repeated item ids as one item;
repeated rows each get the same result; null document ids are kept and told apart
by their text; empty tables give no matches; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm import words
from veilframe.sources.workdir import materialise

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PROBES = 2


@dataclass(frozen=True)
class Block:
    """Items of one block: ids and word hashes."""

    ids: tuple[str, ...]
    items: tuple[np.ndarray, ...]

    def vocabulary(self) -> np.ndarray:
        return np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)


def _task_item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in words.slices(batches, "text"):
        found = words.words(batch.column(1), words.ALNUM)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([found.of(i).tobytes() for i in range(len(found))], pa.binary())],
            names=["item", "hashes"],
        )


def blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[Block]:
    """The items in blocks of ``block_words`` words on average."""
    table = items.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text")
    )
    total = table.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    count = -(-total // block_words)
    for nth in range(count):
        rows = table.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == nth)
        got = rows.mapInArrow(_task_item_words, "item string, hashes binary").toPandas()
        kept = [(i, np.frombuffer(h, np.uint64)) for i, h in zip(got["item"], got["hashes"], strict=True) if h]
        if kept:
            yield Block(*map(tuple, zip(*sorted(kept, key=lambda x: (x[0], x[1].tobytes())), strict=True)))


def _task_term_counts(held):
    """(text) -> (term, n): occurrences of the block's terms in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = held.value
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in words.slices(batches, "text"):
            at, known = _lookup(words.words(batch.column(0), words.ALNUM).hashes, terms)
            total += np.bincount(at[known], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"]
        )

    return run


def _task_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id, th) -> (id, th, n_words)."""
    for batch in words.slices(batches, "text"):
        sizes = np.diff(words.words(batch.column(0), words.ALNUM).offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), batch.column(2), pa.array(sizes)], names=["id", "th", "n_words"]
        )


def _lookup(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    return at, terms[at] == hashes


def choose_probes(block: Block, terms: np.ndarray, counts: np.ndarray, width: int) -> pd.DataFrame:
    """(term, item, place, need): the rarest terms that occur, of all windows with enough of them."""
    out = set()
    for nth, item in enumerate(block.items):
        size = min(width, len(item))
        often = counts[np.searchsorted(terms, item)]
        for start in range(len(item) - size + 1):
            window = often[start : start + size]
            there = np.flatnonzero(window)
            if len(there) >= min(PROBES, size):
                for place in there[np.argsort(window[there], kind="stable")[:PROBES]]:
                    out.add((nth, start + int(place), min(PROBES, size)))
    rows = [(int(np.searchsorted(terms, block.items[n][p])), n, p, need) for n, p, need in sorted(out)]
    return pd.DataFrame(rows, columns=["term", "item", "place", "need"]).astype("int32")


def _task_postings(held):
    """(text, th, id) -> (term, id, th, positions) for the probe terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, numbers = held.value
        for batch in words.slices(batches, "text"):
            found = words.words(batch.column(0), words.ALNUM)
            at, known = _lookup(found.hashes, terms)
            where = np.flatnonzero(known)
            doc = np.searchsorted(found.offsets, where, side="right") - 1
            term = numbers[at[where]]
            position = (where - found.offsets[doc]).astype(np.int32)
            order = np.lexsort((position, term, doc))
            doc, term, position = doc[order], term[order], position[order]
            if not len(doc):
                continue
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])])
            edge = np.concatenate([np.flatnonzero(new), [len(doc)]]).astype(np.int32)
            rows = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(term[new].astype(np.int32)),
                    batch.column(2).take(rows),
                    batch.column(1).take(rows),
                    pa.ListArray.from_arrays(pa.array(edge), pa.array(position)),
                ],
                names=["term", "id", "th", "positions"],
            )

    return run


def phrase_runs(doc: np.ndarray, item: np.ndarray, diagonal: int, width: int) -> list[tuple[int, int]]:
    """Runs of equal words on a diagonal, of a window's length or more, in the document."""
    size = min(width, len(item))
    lo, hi = max(diagonal, 0), min(diagonal + len(item), len(doc))
    if hi - lo < size:
        return []
    equal = np.concatenate([[False], doc[lo:hi] == item[lo - diagonal : hi - diagonal], [False]])
    step = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
    return [(int(a) + lo, int(b) + lo) for a, b in step if b - a >= size]


def _task_compare(held, width: int):
    """(text, id, th, found) -> exact matches (id, th, item, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        for batch in words.slices(batches, "text"):
            found = words.words(batch.column(0), words.ALNUM)
            row, item, start, end = [], [], [], []
            for i, candidates in enumerate(batch.column(3).to_pylist()):
                for c in candidates:
                    for a, b in phrase_runs(found.of(i), block.items[c["item"]], c["diagonal"], width):
                        row.append(i)
                        item.append(block.ids[c["item"]])
                        start.append(a)
                        end.append(b)
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(rows), batch.column(2).take(rows), pa.array(item, pa.string()),
                    pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                ],
                names=["id", "th", "item", "start", "end"],
            )

    return run


def _same_document(a: DataFrame, b: DataFrame):
    return (a["th"] == b["th"]) & a["id"].eqNullSafe(b["id"])


def _block_matches(
    source: DataFrame, block: Block, width: int, slack: int, id_type: str
) -> tuple[DataFrame, DataFrame] | None:
    """Exact and proximity matches of one block."""
    spark = source.sparkSession
    hold = spark.sparkContext.broadcast
    terms = block.vocabulary()
    got = (
        source.select("text").mapInArrow(_task_term_counts(hold(terms)), "term int, n long")
        .groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros(len(terms), dtype=np.int64)
    counts[got["term"].to_numpy()] = got["n"].to_numpy()
    chosen = choose_probes(block, terms, counts, width)
    if not len(chosen):
        return None
    numbers = np.unique(chosen["term"].to_numpy())
    postings = materialise(
        source.select("text", "th", "id").mapInArrow(
            _task_postings(hold((terms[numbers], numbers))),
            f"term int, id {id_type}, th long, positions array<int>",
        ),
        "postings",
    )
    probes = spark.createDataFrame(chosen)  # as many rows as the block has words, at most
    by = ["id", "th", "item"]
    diagonals = (
        postings.join(probes, "term")
        .select("id", "th", "item", "place", "need", F.explode("positions").alias("position"))
        .repartition(*by)
        .groupBy(*by, "need", (F.col("position") - F.col("place")).alias("diagonal"))
        .agg(F.collect_set("place").alias("places"))
    )
    before = Window.partitionBy(*by).orderBy("diagonal")
    either = F.array_union("places", F.lag("places").over(before))
    candidates = materialise(
        diagonals.withColumn("full", F.size("places") >= F.col("need"))
        .withColumn(
            "close",
            F.coalesce(
                (F.col("diagonal") - F.lag("diagonal").over(before) <= slack)
                & (F.size(either) > F.greatest(F.size("places"), F.size(F.lag("places").over(before))))
                & (F.size(either) >= F.col("need")),
                F.lit(False),
            ),
        )
        .filter("full or close").select(*by, "diagonal", "full", "close"),
        "candidates",
    )
    names = spark.createDataFrame(pd.DataFrame({"item": range(len(block.ids)), "name": block.ids}).astype({"item": "int32"}))
    near = (
        candidates.join(names, "item")
        .select("id", "th", F.col("name").alias("item"), F.col("diagonal").cast("long").alias("start"))
    )
    per_doc = candidates.filter("full").groupBy("id", "th").agg(
        F.collect_set(F.struct("item", "diagonal")).alias("found")
    )
    exact = (
        source.join(per_doc, _same_document(source, per_doc))
        .select(source["text"], source["id"], source["th"], "found")
        .dropDuplicates(["id", "th"])
        .mapInArrow(
            _task_compare(hold(block), width),
            f"id {id_type}, th long, item string, start long, end long",
        )
    )
    return materialise(exact, "exact"), materialise(near, "near")


@dataclass(frozen=True)
class Matches:
    """Exact phrase matches (id, th, item, start, end in words), proximity matches
    (id, th, item, start), and the rows of the corpus (id, th, n_words)."""

    exact: DataFrame
    near: DataFrame
    docs: DataFrame


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    slack: int = 3,
    block_words: int = 500_000,
) -> Matches:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    exact = spark.createDataFrame([], f"id {id_type}, th long, item string, start long, end long")
    near = spark.createDataFrame([], f"id {id_type}, th long, item string, start long")
    for block in blocks(items, item_col, item_text_col, block_words):
        found = _block_matches(source, block, width, slack, id_type)
        if found:
            exact, near = exact.unionByName(found[0]), near.unionByName(found[1])
    counted = source.select("text", "id", "th").mapInArrow(
        _task_sizes, f"id {id_type}, th long, n_words long"
    )
    return Matches(exact, near, counted)


def _covered(spans: str):
    """Words in the union of an array of (start, end)."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"),
        ),
    )["n"]


def judge(found: Matches, percent: int = 5) -> DataFrame:
    """One row per row of the corpus: id, th, n_words, n_hit, items, near, n_near,
    contaminated.

    ``near`` holds the items with a proximity match that are not in ``items``; both are sorted.
    """
    none = F.array().cast("array<string>")
    hits = found.exact.groupBy("id", "th").agg(
        _covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    near = found.near.groupBy("id", "th").agg(F.collect_set("item").alias("near"))
    both = found.docs.join(hits, _same_document(found.docs, hits), "left").select(
        found.docs["id"], found.docs["th"], "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    )
    return both.join(near, _same_document(both, near), "left").select(
        both["id"], both["th"], "n_words", "n_hit", "items",
        F.array_sort(F.array_except(F.coalesce("near", none), "items")).alias("near"),
        F.size(F.array_except(F.coalesce("near", none), "items")).cast("long").alias("n_near"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )
