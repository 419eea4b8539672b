"""Mixing sources to target weights: a curriculum whose weights change over time.

Each source has a weight schedule over the run's time 0 to 1, a line through
given points. Its integral is the source's share of all words, and, cut at
``cap`` times the source's own words, its target. A source's documents are laid
end to end in hash order, again and again up to the target; the demand curve
(the schedule's integral so far) is inverted at the words that lie before a
document to give its training position. Ordering by position is the mix.

Everything is DataFrame functions. Rows are shuffled once, by source and hash
cell, so a source with a third of all rows spreads over all tasks; what is kept
per source is one row of a table that has as many rows as there are sources.

Defined results: null text has size 0 and is never taken; a null source is a
source of its own, last in order; null ids are ordered by their text; repeated
rows are separate documents; an empty table gives an empty table; columns of the
input stay, and names this module adds replace equal ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm import layout

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Schedule:
    """Weights at times from 0 to 1; linear between them."""

    points: tuple[tuple[float, float], ...]

    def segments(self) -> list[tuple[float, float, float, float, float]]:
        """(start, end, weight at start, weight at end, integral before start)."""
        out, done = [], 0.0
        for (t0, w0), (t1, w1) in zip(self.points, self.points[1:], strict=False):
            out.append((t0, t1, w0, w1, done))
            done += (t1 - t0) * (w0 + w1) / 2
        return out

    def area(self) -> float:
        return sum((t1 - t0) * (w0 + w1) / 2 for t0, t1, w0, w1, _ in self.segments())


#: Shares 5, 2 and 1: the first fades, the second stays, the third grows.
FADING = Schedule(((0.0, 7.5), (1.0, 2.5)))
STEADY = Schedule(((0.0, 2.0), (1.0, 2.0)))
GROWING = Schedule(((0.0, 0.5), (1.0, 1.5)))
DEFAULT_SCHEDULES = (FADING, STEADY, GROWING)


def _by_class(values: Sequence, build) -> Column:
    """The literal of a source's class, classes repeating along the source order."""
    return F.element_at(
        F.array(*[build(v) for v in values]), (F.col("__nth") % len(values) + 1).cast("int")
    )


def _segments(schedule: Schedule) -> Column:
    names = ("t0", "t1", "w0", "w1", "before")
    return F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, seg, strict=True)])
            for seg in schedule.segments()
        ]
    )


def source_targets(sizes: DataFrame, schedules: Sequence[Schedule], cap: float) -> DataFrame:
    """Targets from one row per source (``__src``, ``source_size``).

    Water level: with sources ordered by the level at which they are full, the
    level that spends all words is the highest of "what is left after the full
    ones, over the weights of the rest". A target is the smaller of the source's
    cap and its weight times the level; this is where resharing the excess of
    full sources by weight ends.
    """
    numbered = sizes.withColumn(
        "__nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__src")) - 1
    )
    full = (
        numbered.withColumn("__weight", _by_class(schedules, lambda s: F.lit(s.area())))
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__full_at", F.col("__cap") / F.col("__weight"))
    )
    every = Window.partitionBy(F.lit(0))
    rising = every.orderBy("__full_at", "__src").rowsBetween(Window.unboundedPreceding, 0)
    falling = every.orderBy(F.desc("__full_at"), F.desc("__src")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    left = F.sum("source_size").over(every) - (F.sum("__cap").over(rising) - F.col("__cap"))
    level = F.max(F.col("__left") / F.col("__open")).over(every)
    return (
        full.withColumn("__left", left)
        .withColumn("__open", F.sum("__weight").over(falling))
        .withColumn("target", F.least("__cap", F.col("__weight") * level))
        .withColumn("__take", F.floor(F.col("target") + 0.5).cast("long"))
        .withColumn(
            "__passes",
            F.when(F.col("source_size") > 0, F.floor(F.col("__take") / F.col("source_size")))
            .otherwise(0)
            .cast("long"),
        )
        .withColumn("__rest", F.col("__take") - F.col("__passes") * F.col("source_size"))
        .withColumn("__segments", _by_class(schedules, _segments))
        .select("__src", "source_size", "target", "__passes", "__rest", "__weight", "__segments")
    )


def _time_of(demand: Column) -> Column:
    """The time at which the schedule's integral reaches ``demand``."""
    found = F.element_at(
        F.filter("__segments", lambda s: (s["before"] <= demand) | (s["before"] == 0)), -1
    )
    rest = F.greatest(demand - found["before"], F.lit(0.0))
    slope = (found["w1"] - found["w0"]) / (found["t1"] - found["t0"])
    root = F.sqrt(F.greatest(found["w0"] * found["w0"] + slope * rest * 2, F.lit(0.0)))
    bottom = found["w0"] + root
    return F.least(
        found["t0"] + F.when(bottom > 0, rest * 2 / bottom).otherwise(0.0), found["t1"]
    )


def position(nth_pass: Column) -> Column:
    """Time (0 to 1) at which a row of ``mix`` enters in its pass number ``nth_pass``."""
    words = (nth_pass * F.col("source_size") + F.col("__before")).cast("double")
    return _time_of(words / F.col("target") * F.col("__weight"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    schedules: Sequence[Schedule] = DEFAULT_SCHEDULES,
    cap: float = 3.0,
    seed: str = "mix",
) -> DataFrame:
    """Each row of ``docs`` with what the mix takes of it.

    Adds ``size`` (words), ``source_size``, ``target`` (words, of its source),
    ``taken`` (words, repeats counted) and ``position`` (0 to 1, of its first
    use; null if never used), and columns with ``__`` that ``training_order``
    needs. The document in which a source's last pass ends is taken in part.
    """
    text = F.col(text_col)
    rows = layout.with_cells(
        docs.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
        # "v" before a name and "w" for none: order by code point, none last
        .withColumn("__src", F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("w")))
        .withColumn("__hash", layout.order_hash(seed, F.col(id_col), text)),
        "__hash",
    )
    totals = layout.cell_totals(rows, ["__src"], "size")
    sizes = totals.groupBy("__src").agg(F.sum("__total").alias("source_size"))
    cells = layout.cell_offsets(totals, ["__src"]).join(
        source_targets(sizes, schedules, cap), "__src"
    )
    kept = [c for c in rows.columns if c not in ("source_size", "target", "taken", "position")]
    laid = (
        rows.select(kept)
        .join(cells, ["__src", layout.CELL])
        .withColumn("__before", layout.sum_before(["__src"], ["__hash", "size"], "size"))
        .withColumn(
            "taken",
            F.col("__passes") * F.col("size")
            + F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - F.col("__before"))),
        )
        .withColumn("position", F.when(F.col("taken") > 0, position(F.lit(0))))
    )
    return laid.drop(layout.CELL, "__offset", "__src")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per use of a document, range-sorted by training position.

    ``words`` is how much of the document this use takes: all of it, but for the
    last document of a source's last pass.
    """
    uses = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    return (
        mixed.filter(F.col("taken") > 0)
        .withColumn("__pass", F.explode(F.sequence(F.lit(0), (uses - 1).cast("int"))))
        .withColumn("position", position(F.col("__pass")))
        .withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("__pass") * F.col("size")))
        .repartitionByRange("position", "__hash")
        .sortWithinPartitions("position", "__hash")
    )
