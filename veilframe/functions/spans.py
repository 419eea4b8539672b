"""Find-all with offsets, overlap resolution and splicing, as column expressions.

Offsets are 0-based code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.checks import luhn_valid

SPAN_TYPE = (
    "struct<type:string,start:int,end:int,value:string,"
    "confidence:double,detector_name:string>"
)
SPANS_TYPE = f"array<{SPAN_TYPE}>"
MATCHES_TYPE = (
    "array<struct<type:string,confidence:double,detector_name:string,luhn:boolean,"
    "cuts:array<string>>>"
)
# Unicode noncharacters: never part of a text meant for exchange, and no
# pattern or term may match them.
MARK, _OTHER = "\uffff", "\ufffe"
# So many numbers are summed up in one expression.
_BLOCK = 8
_HITS_TYPE = "array<struct<start:int,value:string>>"
_PIECES_TYPE = "array<struct<start:int,text:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(array_type: str = SPANS_TYPE) -> Column:
    return F.array().cast(array_type)


def _marked(text: Column, pattern: str) -> Column:
    return cut_at(text, F.lit(pattern))


def cut_at(text: Column, pattern: Column) -> Column:
    """Text cut around every match: gap, match, gap, ..., gap.

    One pass of the pattern sets a mark on both sides of each match, and the
    marks are cheap to split at.
    """
    return F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), MARK, -1)


def unmarked(text: Column) -> Column:
    """Text without the mark character; no length changes."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, _OTHER)).otherwise(text)


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each whole number of an array, those before it combined, from 0.

    An array grown element by element is copied every time. So blocks of ``_BLOCK`` are combined
    in one expression each, and so are their totals; only the totals of those grow an array.
    """
    def grown(items: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("each")),
            lambda acc, x: F.struct(
                combine(acc["all"], x).alias("all"),
                F.concat(acc["each"], F.array(acc["all"])).alias("each"),
            ),
        )["each"]

    def totals(items: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _BLOCK).cast("int"))
        return F.transform(
            blocks, lambda i: reduce(combine, [F.get(items, i * _BLOCK + k) for k in range(_BLOCK)])
        )

    def spread(far: Column, items: Column) -> Column:
        """What is before each item, from what is before each block; behind the last item anything."""
        def block(f: Column, i: Column) -> Column:
            inner = [F.get(items, i * _BLOCK + k) for k in range(_BLOCK - 1)]
            return F.array(*accumulate([f, *inner], combine))

        return F.flatten(F.transform(far, block))

    def each(all_: Column) -> Column:
        far = let(totals(all_), lambda ts: spread(grown(totals(ts)), ts))
        return F.when(F.size(all_) <= _BLOCK, grown(all_)).otherwise(
            F.slice(spread(far, all_), F.lit(1), F.size(all_))
        )

    # the blocks all read it, so it is worked out first
    return let(values, each)


def _sums_before(values: Column) -> Column:
    return before(values, lambda a, b: a + b)


def own_values(text: Column, spans: Column) -> Column:
    """Spans found in ``unmarked`` text with their values as the text has them."""
    return F.when(
        F.contains(text, F.lit(MARK)),
        F.transform(
            spans,
            lambda s: s.withField("value", F.substring(text, s["start"] + 1, s["end"] - s["start"])),
        ),
    ).otherwise(spans)


def _placed(cuts: Column) -> Column:
    """The matches among ``_marked`` cuts as ``array<struct<start,value>>``."""
    def odd(parts: Column) -> Column:
        gap = lambda i: F.length(F.get(parts, i * 2))
        hit = lambda i: F.get(parts, i * 2 + 1)
        both = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1),
            lambda i: gap(i) + F.length(hit(i)),
        )
        return F.transform(
            _sums_before(both),
            lambda at, i: F.struct((at + gap(i)).alias("start"), hit(i).alias("value")),
        )

    return let(
        cuts, lambda parts: F.when(F.size(parts) < 2, empty(_HITS_TYPE)).otherwise(odd(parts))
    )


def find_all(text: Column, pattern: str) -> Column:
    """Every leftmost, non-overlapping match as ``array<struct<start,value>>``."""
    return _placed(_marked(unmarked(text), pattern))


def matches(
    text: Column, pattern: str, type_: str, confidence: float, detector_name: str,
    luhn: bool = False, gate: Column | None = None,
) -> Column:
    """One pattern's matches in ``unmarked`` text, not yet placed; NULL where ``gate`` is false."""
    found = F.struct(
        F.lit(type_).alias("type"),
        F.lit(float(confidence)).alias("confidence"),
        F.lit(detector_name).alias("detector_name"),
        F.lit(luhn).alias("luhn"),
        _marked(text, pattern).alias("cuts"),
    )
    return found if gate is None else F.when(gate, found)


def place(found: Column) -> Column:
    """Spans of an array of ``matches``, in its order.

    The placing expression appears once, whatever the number of patterns.
    """
    def one(m: Column) -> Column:
        kept = F.filter(
            _placed(m["cuts"]), lambda h: ~m["luhn"] | luhn_valid(h["value"])
        )
        return F.transform(
            kept,
            lambda h: F.struct(
                m["type"], h["start"],
                (h["start"] + F.length(h["value"])).alias("end"),
                h["value"], m["confidence"], m["detector_name"],
            ),
        )

    # one part is a text without a match
    hit = F.filter(found, lambda m: m.isNotNull() & (F.size(m["cuts"]) > 1))
    return F.flatten(F.transform(hit, one))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    """Spans in text order."""
    return F.transform(
        F.array_sort(
            F.transform(
                spans, lambda s: F.struct(s["start"].alias("k"), s["end"].alias("e"), s.alias("s"))
            )
        ),
        lambda k: k["s"],
    )


def _clusters(spans: Column) -> Column:
    """Spans grouped where they touch: an array of arrays, in text order."""
    entries = F.array_sort(
        F.transform(
            spans,
            lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")),
        )
    )

    def cut(sorted_: Column, reach: Column) -> Column:
        # a cluster opens where all spans before have ended
        opens = F.filter(
            F.sequence(F.lit(0), F.size(sorted_) - 1),
            lambda i: F.get(sorted_, i)["start"] >= F.get(reach, i),
        )
        return let(
            opens,
            lambda o: F.transform(
                o,
                lambda at, j: F.slice(
                    sorted_, at + 1, F.coalesce(F.get(o, j + 1), F.size(sorted_)) - at
                ),
            ),
        )

    return let(
        entries,
        lambda e: let(before(F.transform(e, lambda x: x["s"]["end"]), F.greatest), lambda r: cut(e, r)),
    )


def _best(cluster: Column) -> Column:
    """Greedy choice by confidence, then list position."""
    ranked = F.array_sort(
        F.transform(
            cluster,
            lambda e: F.struct(
                (-e["s"]["confidence"]).alias("c"), e["i"].alias("i"), e["s"].alias("s")
            ),
        )
    )
    return F.aggregate(
        ranked,
        empty(),
        lambda acc, r: F.when(
            F.exists(acc, lambda a: overlaps(a, r["s"])), acc
        ).otherwise(F.concat(acc, F.array(r["s"]))),
    )


def resolve(spans: Column) -> Column:
    """Keep a disjoint subset, in text order.

    Spans are taken by confidence (highest first), then list position, and kept
    when they touch nothing kept before. Only spans of one cluster of touching
    spans are compared with each other, so a text full of spans stays cheap.
    """
    chosen = lambda all_: F.flatten(
        F.transform(
            _clusters(all_),
            lambda c: F.when(F.size(c) < 2, F.transform(c, lambda e: e["s"])).otherwise(
                by_start(_best(c))
            ),
        )
    )
    return let(spans, lambda s: F.when((F.size(s) < 2) | _apart(s), s).otherwise(chosen(s)))


def _apart(spans: Column) -> Column:
    """Whether spans are in text order and each begins where the one before has ended, or later."""
    return F.forall(
        F.sequence(F.lit(1), F.size(spans) - 1),
        lambda i: F.get(spans, i)["start"] >= F.get(spans, i - 1)["end"],
    )


def shift(spans: Column, offset: Column) -> Column:
    """Move spans found in a piece of text to their place in the whole."""
    return F.transform(
        spans,
        lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset),
    )


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """Replace disjoint, ordered spans; everything between is kept as it is."""
    def piece(all_: Column) -> Callable[[Column, Column], Column]:
        def build(s: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(0)).otherwise(F.get(all_, i - 1)["end"])
            return F.concat(F.substring(text, begin + 1, s["start"] - begin), replacement(s))

        return build

    def body(all_: Column) -> Column:
        tail = F.substring(text, F.element_at(all_, -1)["end"] + 1, F.octet_length(text))
        return F.concat(F.array_join(F.transform(all_, piece(all_)), ""), tail)

    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(body(s)))


def units(text: Column, unit_chars: int, glue: str | None, never: str = "") -> Column:
    """Cut text into pieces of about ``unit_chars`` that no match can straddle.

    A cut lies before white space whose preceding character is neither white
    space nor in ``glue``, or before a character of ``never``, which no match
    holds. Pieces concatenate to the text. With ``glue=None`` (a detector whose
    matches are unknown) the text stays whole.
    """
    whole = F.when(
        F.octet_length(text) > 0,
        F.array(F.struct(F.lit(0).alias("start"), text.alias("text"))),
    ).otherwise(empty(_PIECES_TYPE))
    if glue is None:
        return whole
    pieces = F.regexp_extract_all(text, F.lit(unit_pattern(unit_chars, glue, never)), F.lit(0))
    placed = let(
        pieces,
        lambda ps: F.zip_with(
            _sums_before(F.transform(ps, F.length)),
            ps,
            lambda at, p: F.struct(at.alias("start"), p.alias("text")),
        ),
    )
    # bytes first: they need no count; most texts show a place for a cut at once, some hold none
    long = (F.octet_length(text) > unit_chars) & (F.length(text) > unit_chars)
    long &= text.rlike(rf"[\t\n\f\r {_in_class(never)}]")
    return F.when(long, placed).otherwise(whole)


def _in_class(characters: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(characters)))


def cut_class(glue: str) -> str:
    """Character class of what may stand left of a cut at white space."""
    return rf"[^\t\n\f\r {_in_class(glue)}]"


def cut_here(glue: str, never: str = "") -> str:
    """Zero-width pattern for a place that no match straddles."""
    here = rf"(?<={cut_class(glue)})(?=[\t\n\f\r ])"
    return f"(?:{here}|(?=[{_in_class(never)}]))" if never else here


def unit_pattern(unit_chars: int, glue: str, never: str = "") -> str:
    return rf"(?s)\G(?:.{{{unit_chars},}}?{cut_here(glue, never)}|.+)"
