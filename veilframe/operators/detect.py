"""Detection: text to scored spans.

A detector turns a text column into an array of spans. Built-in detectors are
plain column expressions, so a scan is a narrow transformation: no shuffle, no
Python worker. Long texts are cut at places no match can straddle and scanned
piece by piece, which keeps the work linear in the text length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache, reduce
from itertools import groupby
from operator import and_
from typing import Protocol, runtime_checkable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.patterns import NEVER, PATTERNS, Pattern, edge_test
from veilframe.functions.spans import (
    MARK,
    MATCHES_TYPE,
    SPANS_TYPE,
    empty,
    let,
    matches,
    own_values,
    place,
    resolve,
    shift,
    units,
    unmarked,
)

MAX_INLINE_TERMS = 200


@runtime_checkable
class Detector(Protocol):
    """Extension point.

    ``glue`` lists the characters that can stand right before white space
    inside one of the detector's matches; ``None`` means unknown, and texts are
    then scanned whole. ``never``, if there is one, lists characters that no
    match holds. ``on_rows`` marks detectors backed by a Python UDF,
    which Spark evaluates on a table column but not inside an array function.
    """

    name: str
    glue: str | None
    on_rows: bool

    def spans(self, text: Column) -> Column: ...


class PatternDetector:
    """Regular-expression detection."""

    name = "regex"
    on_rows = False

    def __init__(self, patterns: Iterable[Pattern] = PATTERNS) -> None:
        self.patterns = tuple(patterns)

    @property
    def glue(self) -> str | None:
        parts = [p.glue for p in self.patterns]
        return None if None in parts else "".join(parts)

    @property
    def never(self) -> str:
        return common(p.never for p in self.patterns)

    def at_least(self, confidence: float) -> PatternDetector:
        """Leave out patterns whose fixed score is below the threshold."""
        return PatternDetector(p for p in self.patterns if p.confidence >= confidence)

    def matches(self, text: Column) -> Column:
        parts = [empty(MATCHES_TYPE)]
        # Neighbours that need a digit share their tests; list order is kept.
        for digits, group in groupby(self.patterns, key=lambda p: p.digits):
            near = list(group)
            found = F.array(*[self._one(text, p) for p in near])
            if digits:
                can = reduce(and_, [text.rlike(r) for r in ["[0-9]", *edge_test(near)]])
                found = F.when(can, found).otherwise(parts[0])
            parts.append(found)
        return F.concat(*parts)

    def _one(self, text: Column, p: Pattern) -> Column:
        return matches(
            text, p.jdk, p.type, p.confidence, p.detector_name, p.luhn, gate=p.gate(text)
        )

    def spans(self, text: Column) -> Column:
        found = let(unmarked(text), lambda t: place(self.matches(t)))
        return own_values(text, found)


class TermDetector:
    """Case-insensitive substring search for a short list of terms."""

    name = "blocklist"
    on_rows = False

    def __init__(self, terms: Iterable[str]) -> None:
        self.terms = clean_terms(terms)
        if len(self.terms) > MAX_INLINE_TERMS:
            raise ValueError(
                f"{len(self.terms)} terms: above {MAX_INLINE_TERMS} use terms.scan_with_terms"
            )

    @property
    def glue(self) -> str:
        return term_glue(self.terms)

    @property
    def never(self) -> str:
        return "".join(c for c in NEVER if not any(c in t for t in self.terms))

    def matches(self, text: Column) -> Column:
        if not self.terms:
            return empty(MATCHES_TYPE)
        # One pass tells whether any term occurs; few texts need the rest.
        starts = "".join(f"\\x{{{ord(c):x}}}" for t in self.terms for c in letter_cases(t[0]))
        any_term = f"(?=[{starts}])(?iu)(?:{'|'.join(map(quote, self.terms))})"
        found = [
            matches(text, "(?iu)" + quote(t), "blocklist", 1.0, self.name) for t in self.terms
        ]
        return F.when(text.rlike(any_term), F.array(*found)).otherwise(empty(MATCHES_TYPE))

    def spans(self, text: Column) -> Column:
        found = let(unmarked(text), lambda t: place(self.matches(t)))
        return own_values(text, found)


def common(parts: Iterable[str]) -> str:
    """Characters that all parts hold."""
    sets = [set(p) for p in parts]
    return "".join(sorted(set.intersection(*sets))) if sets else ""


def clean_terms(terms: Iterable[str]) -> tuple[str, ...]:
    """Lower-cased, distinct, in first-seen order; an empty term is an error."""
    seen = dict.fromkeys(t.lower() for t in terms)
    if "" in seen:
        raise ValueError("an empty term would match everywhere")
    if any(MARK in t for t in seen):
        raise ValueError("a term holds U+FFFF")
    return tuple(seen)


def term_glue(terms: Iterable[str]) -> str:
    """Characters before white space inside a term, in every letter case."""
    lefts = {
        term[i - 1]
        for term in terms
        for i in range(1, len(term))
        if term[i] in "\t\n\f\r " and term[i - 1] not in "\t\n\f\r "
    }
    return "".join(sorted({v for c in lefts for v in letter_cases(c)}))


def letter_cases(c: str) -> set[str]:
    """All characters that equal ``c`` when letter case is ignored."""
    # Letters with a case partner outside their own pair.
    extra = {
        "k": "\u212a", "s": "\u017f", "å": "\u212b", "i": "İı",
        "ß": "\u1e9e", "µ": "\u03bc", "ω": "\u2126",
    }
    more = extra.get(c.lower(), "") if len(c.lower()) == 1 else ""
    return {v for v in (c, c.lower(), c.upper(), *more) if len(v) == 1}


def quote(term: str) -> str:
    """The term as a literal regex."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in term)


class RowDetector:
    """Wrap a pandas UDF that returns ``array<span>`` for a text column."""

    glue = None
    on_rows = True

    def __init__(self, name: str, udf: Callable[[Column], Column]) -> None:
        self.name = name
        self._udf = udf

    def spans(self, text: Column) -> Column:
        return F.coalesce(self._udf(text).cast(SPANS_TYPE), empty())


def all_spans(
    text: Column, detectors: Iterable[Detector], given: Mapping[int, Column] | None = None
) -> Column:
    """All detectors' output in their order, overlaps included.

    ``given`` holds the spans of detectors (by place) that were run before.
    """
    parts, given = [empty()], given or {}
    for listed, group in groupby(enumerate(detectors), key=lambda d: hasattr(d[1], "matches")):
        if listed:
            known = [d for _, d in group]
            found = let(unmarked(text), lambda t: place(F.concat(*[d.matches(t) for d in known])))
            parts.append(own_values(text, found))
        else:
            parts += [given[i] if i in given else d.spans(text) for i, d in group]
    return F.concat(*parts)


def unit_spans(text: Column, cfg: ScanConfig, given: Mapping[int, Column] | None = None) -> Column:
    """Resolved, thresholded, allow-listed spans of one piece of text."""
    found = all_spans(text, _active(cfg), given)
    return keep_allowed(above(resolve(found), cfg.threshold), cfg.allowlist)


def _active(cfg: ScanConfig) -> list:
    return [
        d.at_least(cfg.threshold) if isinstance(d, PatternDetector) else d for d in cfg.detectors
    ]


def above(spans: Column, threshold: float) -> Column:
    """Spans scoring at least the threshold; a threshold of zero keeps all."""
    if threshold <= 0:
        return spans
    return F.filter(spans, lambda s: s["confidence"] >= F.lit(float(threshold)))


def keep_allowed(spans: Column, allowlist: Iterable[str]) -> Column:
    """Drop spans whose whole value, ignoring case, is on the list."""
    safe = sorted({a.lower() for a in allowlist})
    if not safe:
        return spans
    listed = F.array(*[F.lit(a) for a in safe])
    return F.filter(spans, lambda s: ~F.array_contains(listed, F.lower(s["value"])))


def keep_unlisted(df: DataFrame, spans: str, allowed: DataFrame, column: str = "value") -> DataFrame:
    """Drop spans whose whole value, ignoring case, is in a table of any length.

    The table form of ``keep_allowed``, for scanned rows before they are redacted.
    Rows with the same values are one set; distinct sets meet the table value by
    value, and only what is listed comes back, dealt by salts. Texts are joined once,
    rows without spans are spread. Null entries allow nothing; an empty table drops
    nothing.
    """
    from veilframe.operators.guards import left_join_salted

    values = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.lower(s["value"]))))
    name = F.when(F.size(spans) > 0, F.sha2(F.to_json(values).cast("binary"), 256))
    listed = allowed.select(F.lower(column).alias("_v")).filter("_v is not null").distinct()
    sets = df.select(name.alias("_set"), values.alias("_vs")).filter("_set is not null")
    safe = (
        sets.groupBy("_set").agg(F.first("_vs").alias("_vs"))  # one name, one set of values
        .select("_set", F.explode("_vs").alias("_v"))
        .join(listed, "_v")
        .groupBy("_set").agg(F.collect_list("_v").alias("_safe"))
    )
    met = left_join_salted(df, name, safe, "_set")
    kept = F.filter(spans, lambda s: ~F.array_contains("_safe", F.lower(s["value"])))
    return met.withColumn(spans, F.when(F.col("_safe").isNull(), F.col(spans)).otherwise(kept)).drop("_safe")


def glue_of(cfg: ScanConfig) -> str | None:
    parts = [d.glue for d in cfg.detectors]
    return None if any(p is None for p in parts) else "".join(parts)


def never_of(cfg: ScanConfig) -> str:
    """Characters that no detector's match holds."""
    return common(getattr(d, "never", "") for d in cfg.detectors)


def analysed_units(text: Column, cfg: ScanConfig) -> Column:
    """``array<struct<start,text,spans>>``: the pieces of a text and their spans."""
    return F.transform(
        units(text, cfg.unit_chars, glue_of(cfg), never_of(cfg)),
        lambda u: F.struct(
            u["start"].alias("start"),
            u["text"].alias("text"),
            unit_spans(u["text"], cfg).alias("spans"),
        ),
    )


def scan_column(text: Column, cfg: ScanConfig) -> Column:
    """Spans of a text as one expression; needs detectors without a Python UDF."""
    if any(d.on_rows for d in cfg.detectors):
        raise ValueError("detectors backed by a UDF need scan() on a table")
    if glue_of(cfg) is None:
        return F.coalesce(unit_spans(text, cfg), empty())
    found = F.transform(
        analysed_units(text, cfg),
        lambda u: F.when(u["start"] == 0, u["spans"]).otherwise(shift(u["spans"], u["start"])),
    )
    return F.coalesce(F.flatten(found), empty())


@lru_cache(maxsize=64)
def _scan_expression(text: str, cfg: ScanConfig, gateway: int) -> Column:
    """Building the expression takes thousands of JVM calls; reuse it."""
    return scan_column(F.col(text), cfg)


def scan(df: DataFrame, text: str, cfg: ScanConfig, out: str = "spans") -> DataFrame:
    """Add the spans of ``text``; null and empty text yield an empty array."""
    on_rows = {i: f"_{out}_{i}" for i, d in enumerate(cfg.detectors) if d.on_rows}
    if not on_rows:
        return df.withColumn(out, _scan_expression(text, cfg, id(SparkContext._gateway)))
    for i, name in on_rows.items():
        df = df.withColumn(name, cfg.detectors[i].spans(F.col(text)))
    found = unit_spans(F.col(text), cfg, {i: F.col(n) for i, n in on_rows.items()})
    return df.withColumn(out, F.coalesce(found, empty())).drop(*on_rows.values())


def oversize(text: Column, cfg: ScanConfig) -> Column:
    """Whether a text is longer than the configuration's watch mark; never a reason to skip it."""
    return F.coalesce(F.length(text) > cfg.watched_chars, F.lit(False))


def raw_spans(text: Column, cfg: ScanConfig) -> Column:
    """All detectors' output joined, before resolution, threshold and allowlist."""
    columns = [d for d in cfg.detectors if not d.on_rows]
    found = F.transform(
        units(text, cfg.unit_chars, glue_of(cfg), never_of(cfg)),
        lambda u: shift(all_spans(u["text"], columns), u["start"]),
    )
    return F.coalesce(F.flatten(found), empty())


def explode_spans(df: DataFrame, *keys: str, spans: str = "spans") -> DataFrame:
    """One row per span.

    ``inline_outer`` plus a filter rather than ``inline``: for the latter Spark
    derives a size test on the array and pushes it below the projection that
    builds it, so that the patterns would run twice.
    """
    return df.select(*keys, F.inline_outer(spans)).filter(F.col("type").isNotNull())


def byte_start(text: Column, start: Column) -> Column:
    """UTF-8 byte offset of a code-point offset."""
    return F.octet_length(F.substring(text, F.lit(1), start))
