"""Text that arrives in ordered chunks, as a batch table.

A value may be split over chunks and one stream may hold most of the table, so
neither a chunk nor a stream is a workable unit. Chunks are re-cut by character
offset into cells of fixed length, which spread over all tasks; a cell is then
cut where no match can straddle, and only the short seams between cells meet
again in a small shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import CHUNK_TAIL_CHARS, ScanConfig
from veilframe.functions.crypto import Keyring
from veilframe.functions.spans import cut_here
from veilframe.operators.detect import glue_of, never_of
from veilframe.operators.ordered import BLOCK, null_safe_join, running_total, sequence_blocks
from veilframe.operators.redact import redact

CELL_CHARS = 65_536


def split_chunks(text: Column, chars: int) -> Column:
    """A text as an array of chunks of ``chars`` characters."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))


def with_offsets(chunks: DataFrame, stream: str, seq: str, chunk: str) -> DataFrame:
    """Add ``at``: the characters before each chunk. ``seq`` is a distinct integer."""
    blocked = sequence_blocks(chunks, seq)
    size = F.coalesce(F.length(chunk), F.lit(0)).cast("bigint")
    ended = running_total(blocked, [stream], [seq], size, "_end")
    return ended.withColumn("at", F.col("_end") - size).drop("_end", BLOCK)


def _pieces(at: Column, chunk: Column, cell_chars: int) -> Column:
    """A chunk cut at cell borders: ``array<struct<at,text>>``, linear in its length."""
    first = (F.lit(cell_chars) - at % cell_chars).cast("int")
    head = F.substring(chunk, F.lit(1), first)
    rest = split_chunks(F.substring(chunk, first + 1, F.length(chunk)), cell_chars)
    return F.concat(
        F.array(F.struct(at.alias("at"), head.alias("text"))),
        F.transform(
            rest,
            lambda t, i: F.struct(
                (at + first + i.cast("bigint") * cell_chars).alias("at"), t.alias("text")
            ),
        ),
    )


def _joined(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def to_cells(
    chunks: DataFrame, stream: str, seq: str, chunk: str, cell_chars: int = CELL_CHARS
) -> DataFrame:
    """``stream, cell, at, text``: the stream re-cut every ``cell_chars`` characters."""
    placed = with_offsets(chunks.select(stream, seq, chunk), stream, seq, chunk)
    pieces = placed.filter(F.length(chunk) > 0).select(
        stream, F.inline(_pieces(F.col("at"), F.col(chunk), cell_chars))
    )
    return (
        pieces.withColumn("cell", F.floor(F.col("at") / cell_chars).cast("bigint"))
        .groupBy(stream, "cell")
        .agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
        .select(stream, "cell", F.get("p", F.lit(0))["at"].alias("at"), _joined(F.col("p")).alias("text"))
    )


def to_units(
    chunks: DataFrame,
    stream: str,
    seq: str,
    chunk: str,
    glue: str,
    cell_chars: int = CELL_CHARS,
    never: str = "",
) -> DataFrame:
    """``stream, at, text``: pieces of a stream that no match can straddle.

    Units are disjoint and cover the stream; a match lies in exactly one. Cuts lie
    at white space, as ``glue`` allows, and before characters of ``never``.
    """
    here = cut_here(glue, never)
    cells = to_cells(chunks, stream, seq, chunk, cell_chars)
    head = F.length(F.regexp_extract("text", rf"(?s)\A(.+?){here}", 1))
    upto = F.length(F.regexp_extract("text", rf"(?s)\A(.+){here}", 1))
    cells = cells.withColumn("_head", head).withColumn("_upto", upto)
    cut = F.col("_head") > 0

    def piece(back: int, begin: Column, end: Column) -> Column:
        return F.struct(
            F.lit(back).alias("back"),
            (F.col("at") + begin).alias("at"),
            F.substring("text", begin + 1, end - begin).alias("text"),
        )

    # Most of a cell is a unit of its own and is not shuffled again.
    middle = piece(0, F.col("_head"), F.col("_upto"))
    middles = cells.filter(cut).select(stream, middle["at"].alias("at"), middle["text"].alias("text"))

    # What lies before the first or after the last cut joins its neighbours': a
    # seam runs from one cell with a cut to the next such cell.
    size = F.length("text")
    edges = cells.select(
        stream, "cell", cut.cast("bigint").alias("_cut"),
        F.when(cut, F.array(piece(1, F.lit(0), F.col("_head")), piece(0, F.col("_upto"), size)))
        .otherwise(F.array(piece(0, F.lit(0), size))).alias("_parts"),
    )
    counted = running_total(
        sequence_blocks(edges, "cell"), [stream], ["cell"], F.col("_cut"), "_seam"
    )
    seams = (
        counted.select(stream, "_seam", F.inline("_parts"))
        .withColumn("seam", F.col("_seam") - F.col("back"))
        .groupBy(stream, "seam")
        .agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("p"))
        .select(stream, F.get("p", F.lit(0))["at"].alias("at"), _joined(F.col("p")).alias("text"))
    )
    return middles.unionByName(seams).filter(F.length("text") > 0)


def redact_chunks(
    chunks: DataFrame,
    stream: str,
    seq: str,
    chunk: str,
    cfg: ScanConfig,
    keys: Keyring,
    scope: str | None = None,
    cell_chars: int = CELL_CHARS,
) -> DataFrame:
    """``stream, at, text, redacted, spans``: chunked text redacted as if whole.

    The redacted units in order of ``at`` are the redacted stream, whatever the
    chunk size; ``at + start`` of a span is its place in the stream.
    """
    glue = glue_of(cfg)
    if glue is None:
        raise ValueError("chunked redaction needs detectors with known glue")
    units = to_units(chunks, stream, seq, chunk, glue, cell_chars, never_of(cfg))
    scoped = units.withColumn("_scope", F.col(scope or stream).cast("string"))
    return redact(scoped, "text", "_scope", cfg, keys).drop("_scope")


def stream_spans(redacted_units: DataFrame, stream: str) -> DataFrame:
    """Spans placed in their stream (``start``/``end`` count from its beginning)."""
    rows = redacted_units.select(stream, "at", F.inline_outer("spans")).filter(
        F.col("type").isNotNull()
    )
    return rows.withColumn("start", F.col("at") + F.col("start")).withColumn(
        "end", F.col("at") + F.col("end")
    ).drop("at")


def spans_by_chunk(
    spans: DataFrame, chunks: DataFrame, stream: str, seq: str, chunk: str,
    grid: int = 4096,
) -> DataFrame:
    """Map stream spans back to the chunks they touch: an interval join on a grid.

    Both sides are spread over the grid squares they touch; a pair is reported
    in the square where it first meets.
    """
    placed = with_offsets(chunks.select(stream, seq, chunk), stream, seq, chunk)
    ranges = placed.filter(F.length(chunk) > 0).select(
        stream, seq, F.col("at").alias("c_from"), (F.col("at") + F.length(chunk)).alias("c_to")
    )

    def squares(start: Column, end: Column) -> Column:
        return F.explode(
            F.sequence(F.floor(start / grid).cast("bigint"), F.floor((end - 1) / grid).cast("bigint"))
        )

    left = spans.withColumn("_g", squares(F.col("start"), F.col("end")))
    right = ranges.withColumn("_g", squares(F.col("c_from"), F.col("c_to")))
    met = null_safe_join(left, right, [stream, "_g"]).filter(
        (F.col("start") < F.col("c_to"))
        & (F.col("c_from") < F.col("end"))
        & (F.col("_g") == F.floor(F.greatest("start", "c_from") / grid))
    )
    return met.select(
        stream, seq, "type", "detector_name", "token",
        (F.greatest("start", "c_from") - F.col("c_from")).cast("int").alias("chunk_start"),
        (F.least("end", "c_to") - F.col("c_from")).cast("int").alias("chunk_end"),
    )


def chunk_tails(
    chunks: DataFrame, stream: str, seq: str, chunk: str, chars: int = CHUNK_TAIL_CHARS
) -> DataFrame:
    """``stream, seq, tail``: the last ``chars`` characters before each chunk.

    A piece near the end of its cell is also sent to the next cell as context,
    so every tail is read off inside one cell.
    """
    cell_chars = max(chars, 1024)
    placed = with_offsets(chunks.select(stream, seq, chunk), stream, seq, chunk)
    marks = F.transform(
        _pieces(F.col("at"), F.col(chunk), cell_chars),
        lambda p, i: F.struct(
            p["at"].alias("at"), p["text"].alias("text"), (i == 0).alias("first")
        ),
    )
    pieces = placed.filter(F.length(chunk) > 0).select(stream, F.inline(marks))
    # A chunk that is empty, or opens a cell exactly, still needs its position.
    empties = (
        placed.filter(F.coalesce(F.length(chunk), F.lit(0)) == 0)
        .select(stream, "at").distinct()
        .select(stream, "at", F.lit("").alias("text"), F.lit(True).alias("first"))
    )
    every = pieces.unionByName(empties)
    home = F.floor(F.col("at") / cell_chars).cast("bigint")
    reach = (F.col("at") % cell_chars) + F.length("text") > cell_chars - chars
    spread = every.withColumn("_home", home).withColumn(
        "cell",
        F.explode(
            F.when(reach & (F.length("text") > 0), F.array(F.col("_home"), F.col("_home") + 1))
            .otherwise(F.array(F.col("_home")))
        ),
    )
    cells = spread.groupBy(stream, "cell").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "at", F.length("text").alias("n"), "text",
                    (F.col("first") & (F.col("cell") == F.col("_home"))).alias("first"),
                )
            )
        ).alias("p")
    )
    base = F.get("p", F.lit(0))["at"]
    cells = cells.select(stream, base.alias("base"), _joined(F.col("p")).alias("whole"), "p")
    probes = F.transform(
        F.filter("p", lambda x: x["first"]),
        lambda x: F.struct(
            x["at"].alias("at"),
            F.substring(
                "whole",
                (F.greatest(x["at"] - chars, F.col("base")) - F.col("base") + 1).cast("int"),
                F.least(F.lit(chars).cast("bigint"), x["at"] - F.col("base")).cast("int"),
            ).alias("tail"),
        ),
    )
    tails = cells.select(stream, F.inline(F.array_distinct(probes)))
    return null_safe_join(placed.select(stream, seq, "at"), tails, [stream, "at"]).select(
        stream, seq, "tail"
    )
