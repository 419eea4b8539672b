"""Personal data by bootstrapped contextual extraction.

Spans that the base patterns find and check (e-mail, IP, card, phone) are the
seeds. The two words before a seed are a lexical pattern of its kind. Patterns
and instances (values) make a graph that Spark scores in rounds: a pattern is as
sure as the share of all its occurrences in the corpus that lead to instances
believed to be of the kind; an instance as sure as at least one of its patterns.
Patterns that are sure enough, with enough different seeds, then turn
identifier-like spans that the base patterns reject (an address without a
top-level domain, a number without ``+``, a card with a wrong check digit) into
finds. Base spans always stay.

One pass over the texts yields all spans; further ones count how often the
patterns occur, about ``patterns`` of them in each, until all that have enough
seeds are counted. Only hashes of values and contexts are stored, never values.

Defined results: null and empty texts have no spans; null and repeated ids are
rows of their own; ties between kinds go to the surer pattern, then to the kind
listed first; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm import words
from veilframe.sources.workdir import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails everywhere within
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# what else looks like an identifier
_MARK = re.compile(r"@|\(at\)|\[at\]")
_AFTER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.-]*")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_ADDRESS = re.compile(r"(?<![0-9A-Za-z])(?<![0-9]\.)[0-9]++(?:\.[0-9]++){3}(?![0-9A-Za-z])(?!\.[0-9])")
_WORD = re.compile(r"[^ \t-\r]+")
_BEFORE = re.compile(r"([^ \t-\r]+)[ \t-\r]+([^ \t-\r]+)[ \t-\r]+[^ \t-\r]*\Z")
_REACH = 200  # characters that are tried before the words of the whole text

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """One look to the left and right of every ``@``: linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < at and (right := _DOMAIN.match(text, at + 1)):
            done = right.end()
            out.append((left, done))
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """All valid base spans, by start and then by kind."""
    out = [(a, EMAIL, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), PHONE, m.end()))
    return sorted(out)


def handles(text: str) -> list[tuple[int, int]]:
    """What is written like an address around ``@`` or its spelt forms, from each mark to both sides."""
    out, done = [], 0
    for m in _MARK.finditer(text):
        left = m.start()
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        if left < m.start() and (right := _AFTER.match(text, m.end())):
            done = right.end()
            out.append((left, done))
    return out


def clear_of(base: list[Span]) -> Callable[[int, int], bool]:
    """Whether a span touches none of the base spans (sorted by start)."""
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))

    def clear(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before == 0 or reach[before - 1] <= start

    return clear


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, kinds it could be) of identifier-like spans clear of base spans."""
    found = []
    if "@" in text or "(at)" in text or "[at]" in text:
        found += [(a, b, (EMAIL,)) for a, b in handles(text)]
    found += [(m.start(), m.end(), (IP,)) for m in _ADDRESS.finditer(text)]
    for m in _NUMBER.finditer(text):
        n = len(_digits(m[0]))
        kinds = []
        if 14 <= n <= 19:
            kinds.append(CARD)
        if n <= 15:
            kinds.append(PHONE)
        if kinds:
            found.append((m.start(), m.end(), tuple(kinds)))
    clear = clear_of(base)
    return [c for c in found if clear(c[0], c[1])]


def words_before(text: str, starts: list[int]) -> list[str | None]:
    """The two whole words before the word in which each span starts."""
    out, places, known = [], None, {}
    for start in starts:
        lo = max(0, start - _REACH)
        m = _BEFORE.search(text[lo:start])
        if m and (m.start() > 0 or lo == 0):
            out.append(f"{m[1]} {m[2]}")
        elif lo == 0:
            out.append(None)
        else:  # words that reach further back
            if places is None:
                places = np.fromiter((w.start() for w in _WORD.finditer(text)), np.int64)
            at = int(np.searchsorted(places, start, side="right")) - 1
            if at not in known:
                two = [_WORD.match(text, places[i])[0] for i in (at - 2, at - 1)] if at >= 2 else None
                known[at] = two and " ".join(two)
            out.append(known[at])
    return out


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hash of each word together with the next one."""
    return words.mixed(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:]).view(np.int64)


def context_keys(contexts: list[str | None]) -> list[int | None]:
    known = list(dict.fromkeys(c for c in contexts if c))
    if not known:
        return [None] * len(contexts)
    found = words.words(pa.array(known), words.BLANKS)
    keys = dict(zip(known, _pairs(found.hashes)[::2].tolist(), strict=True))  # two words each
    return [keys[c] if c else None for c in contexts]


def _value_key(value: str) -> int:
    """A hash of a value without its punctuation and case."""
    found = words.words(pa.array([re.sub(r"[^0-9A-Za-z@]", "", value) or "-"]), words.BLANKS)
    return int(found.hashes.view(np.int64)[0])


_SPANS = "array<struct<start:int, kind:int, end:int>>"
_SCAN = (
    f"spans {_SPANS}, "
    "seeds array<struct<kind:int, context:bigint, value:bigint>>, "
    "maybe array<struct<kind:int, context:bigint, value:bigint, start:int, end:int>>"
)


def _task_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, id) -> (id, spans, seeds, maybe)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    seed = pa.struct([("kind", pa.int32()), ("context", pa.int64()), ("value", pa.int64())])
    maybe = pa.struct([*seed, pa.field("start", pa.int32()), pa.field("end", pa.int32())])
    for batch in words.slices(batches, "text"):
        spans, seeds, others = [], [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            base = base_spans(text)
            more = candidates(text, base)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            keys = context_keys(words_before(text, [s[0] for s in [*base, *more]]))
            seeds.append([
                {"kind": k, "context": c, "value": _value_key(text[a:b])}
                for (a, k, b), c in zip(base, keys, strict=False) if c is not None
            ])
            others.append([
                {"kind": k, "context": c, "value": _value_key(text[a:b]), "start": a, "end": b}
                for (a, b, kinds), c in zip(more, keys[len(base):], strict=True) if c is not None
                for k in kinds
            ])
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(spans, pa.list_(span)), pa.array(seeds, pa.list_(seed)),
             pa.array(others, pa.list_(maybe))],
            names=["id", "spans", "seeds", "maybe"],
        )


def _task_context_counts(held):
    """(text) -> (context, n): occurrences of the chosen patterns in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = held.value
        total = np.zeros(len(chosen), dtype=np.int64)
        for batch in words.slices(batches, "text"):
            found = words.words(batch.column(0), words.BLANKS)
            if len(found.hashes) < 3 or not len(chosen):
                continue
            owner = found.owner()
            keys = _pairs(found.hashes)[:-1][owner[2:] == owner[:-2]]  # a word must follow
            at = np.searchsorted(chosen, keys)
            at[at == len(chosen)] = 0
            total += np.bincount(at[chosen[at] == keys], minlength=len(chosen))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chosen[some]), pa.array(total[some])], names=["context", "n"]
        )

    return run


def score_patterns(
    seeds: DataFrame, maybe: DataFrame, totals: DataFrame, rounds: int, smoothing: float
) -> DataFrame:
    """(kind, context, sure): how sure each pattern is after ``rounds`` rounds.

    ``seeds`` and ``maybe`` have (kind, context, value), ``totals`` (context, n).
    """
    edges = materialise(
        seeds.withColumn("seed", F.lit(1)).unionByName(maybe.withColumn("seed", F.lit(0)))
        .groupBy("kind", "context", "value")
        .agg(F.count(F.lit(1)).alias("times"), F.max("seed").alias("seed"))
        .join(totals, "context"),
        "edges",
    )
    known = edges.groupBy("kind", "value").agg(F.max("seed").cast("double").alias("belief"))
    for _ in range(rounds):
        sure = (
            edges.join(known, ["kind", "value"])
            .groupBy("kind", "context")
            .agg((F.sum(F.col("times") * F.col("belief")) / (F.max("n") + smoothing)).alias("sure"))
            .withColumn("sure", F.least("sure", F.lit(0.999)))
        )
        sure = materialise(sure, "patterns")
        known = materialise(
            edges.join(sure, ["kind", "context"])
            .groupBy("kind", "value")
            .agg(
                F.max("seed").alias("seed"),
                (1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("belief"),
            )
            .select("kind", "value", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("belief")).alias("belief")),
            "instances",
        )
    return sure


def _learn(
    source: DataFrame, scanned: DataFrame, support: int, patterns: int, rounds: int, smoothing: float
) -> DataFrame | None:
    """Scored patterns with at least ``support`` different seeds."""
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*")
    backed = materialise(
        seeds.groupBy("kind", "context").agg(F.count_distinct("value").alias("backing"))
        .filter(F.col("backing") >= support),
        "backed",
    )
    contexts = backed.select("context").distinct()
    count = -(-contexts.count() // patterns)
    if not count:
        return None
    counted = []
    for nth in range(count):  # what goes to every task has a bound
        chosen = contexts.filter(F.pmod("context", F.lit(count)) == nth).toArrow()
        held = source.sparkSession.sparkContext.broadcast(np.sort(chosen["context"].to_numpy()))
        counted.append(materialise(
            source.select("text").mapInArrow(_task_context_counts(held), "context long, n long")
            .groupBy("context").agg(F.sum("n").alias("n")),
            "contexts",
        ))
        held.unpersist()
    totals = reduce(DataFrame.unionByName, counted)
    maybe = scanned.select(F.explode("maybe").alias("m")).select("m.kind", "m.context", "m.value")
    sure = score_patterns(seeds, maybe, totals, rounds, smoothing)
    return sure.join(backed.select("kind", "context"), ["kind", "context"])


def find(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    support: int = 5,
    certainty: float = 0.6,
    patterns: int = 1_000_000,
    rounds: int = 3,
    smoothing: float = 2.0,
) -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``spans`` (arrays of spans).

    ``base`` holds what the base patterns find, ``spans`` also what contexts add;
    both by start, then kind. Offsets count code points, ends are exclusive.
    ``patterns`` bounds the contexts counted in one pass, not those used.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    scanned = materialise(
        source.mapInArrow(_task_scan, f"id {id_type}, {_SCAN}")
        .withColumn("row", F.monotonically_increasing_id()),
        "scanned",
    )
    plain = scanned.select("row", F.col("id").alias(id_col), F.col("spans").alias("base"))
    learnt = _learn(source, scanned, support, patterns, rounds, smoothing)
    if learnt is None:
        return plain.withColumn("spans", F.col("base")).drop("row")
    best = F.struct(F.col("sure"), (-F.col("m.kind")).alias("first"))
    added = (
        scanned.select("row", F.explode("maybe").alias("m"))
        .join(
            learnt.filter(F.col("sure") >= certainty),
            [F.col("m.kind") == learnt["kind"], F.col("m.context") == learnt["context"]],
        )
        .groupBy("row", "m.start", "m.end")
        .agg(F.max(best).alias("best"))
        .groupBy("row")
        .agg(F.collect_list(F.struct(
            F.col("start"), (-F.col("best.first")).alias("kind"), F.col("end")
        )).cast(_SPANS).alias("added"))
    )
    return plain.join(added, "row", "left").select(
        id_col,
        "base",
        F.when(F.col("added").isNull(), F.col("base"))
        .otherwise(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def spans_text(spans: str):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def count_kind(spans: str, kind: int):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
