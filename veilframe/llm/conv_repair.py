"""Repair of conversation structure at the least cost, with an audit of the edits.

A repaired conversation has the roles ``(s?(ua)+)?``: perhaps a system turn, then
user and assistant in turn. Edits: Keep 0, Rerole to user or assistant 1, Delete 2
(a must for blank and repeated rows), Insert an empty user or assistant turn 5; a
truncated row that stays adds 5. The audit names the edits in order; of equally
cheap ones it is the ASCII-least.

**Run-length DP.** A row is one of nine symbols (role and fault). The state is
what came last: nothing, s, u or a; a symbol is a 4 x 4 matrix of least costs
(min-plus, insertions before the row included). Equal symbols in a row are one
run, and a run of k is the k-th power of its matrix, taken from cached powers
of two. Going back over the runs gives the cost from every state to the end;
choices are then unrolled forwards, each the ASCII-least edit that keeps that
cost. Costs to the end differ by a few small constants only, so the steps within
a run are looked up, too.

**Any length.** Rows are numbered in one range sort (``ordering``) and cut into
chunks of about ``chunk_bytes``. A chunk is one matrix, products of matrices and
the chunks' choice functions from state to state are associative, so a
conversation of many chunks is solved by scans of fan-out ``_FAN``: costs from the
right, states from the left, then each chunk unrolls by itself. Repeats are found
by the first place of each (role, text); only first places are joined back, so a
row that is repeated a billion times splits, too. What stays sequential is what
the result asks for: one audit string and one SHA-256 of the whole repaired text
of a conversation, which streams through one hasher, chunk by chunk.

Defined results: null role or text is one space; rows of a null id are one
conversation; null turns come first; rows equal in turn are ordered by the SHA-256
of length of role, role and text; other columns of the input are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import ordering
from veilframe.sources.workdir import materialise

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_FAR = 1 << 40
_FAN = 512
_NEXT = (2, 2, 3, 2)  # by state: what an inserted or re-roled turn leads to
_NAME = {2: "user", 3: "assistant"}
Vector = tuple[int, int, int, int]

# --- min-plus ---------------------------------------------------------------


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def _closure() -> np.ndarray:
    once = np.full((4, 4), _FAR, dtype=np.int64)
    once[np.arange(4), np.arange(4)] = 0
    once[np.arange(4), _NEXT] = INSERT
    return _times(once, once)


_INSERTS = _closure()
#: Cost from each state once all rows are read: only "nothing" and "a" are ends.
END: Vector = tuple(int(x) for x in (_INSERTS + np.array([0, _FAR, _FAR, 0])).min(axis=1))


def _moves(symbol: str) -> list[list[tuple[str, int, int]]]:
    """Per state the edits of a row as (letter, cost, next state), letters rising."""
    out = []
    for q in range(4):
        edits = [("D", DELETE, q)]
        if symbol != "x":
            role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
            kept = 1 if role == "s" and q == 0 else _NEXT[q] if role == _NAME[_NEXT[q]][0] else None
            if kept is not None:
                edits.append(("K", KEEP + extra, kept))
            edits.append(("R", REROLE + extra, _NEXT[q]))
        out.append(edits)
    return out


@functools.cache
def _power(symbol: str, exponent: int) -> np.ndarray:
    """The symbol's matrix to the power of two to the ``exponent``."""
    if exponent:
        half = _power(symbol, exponent - 1)
        return _times(half, half)
    step = np.full((4, 4), _FAR, dtype=np.int64)
    for q, edits in enumerate(_moves(symbol)):
        for _, cost, to in edits:
            step[q, to] = min(step[q, to], cost)
    return _times(_INSERTS, step)


def _runs(symbols: str) -> list[tuple[str, int]]:
    codes = np.frombuffer(symbols.encode(), np.uint8)
    heads = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else []
    lengths = np.diff(np.append(heads, len(codes))) if len(codes) else []
    return [(symbols[h], int(n)) for h, n in zip(heads, lengths, strict=True)]


def _binary(symbol: str, count: int) -> Iterator[np.ndarray]:
    for bit in range(count.bit_length()):
        if count >> bit & 1:
            yield _power(symbol, bit)


def matrix(symbols: str) -> np.ndarray:
    """Least costs of a row of symbols from state to state."""
    out = np.full((4, 4), _FAR, dtype=np.int64)
    out[np.arange(4), np.arange(4)] = 0
    for symbol, count in _runs(symbols):
        for power in _binary(symbol, count):
            out = _times(out, power)
    return out


def _before(symbol: str, count: int, after: Vector) -> Vector:
    """Costs to the end before a run, from those after it."""
    v = np.array(after, dtype=np.int64)
    for power in _binary(symbol, count):
        v = (power + v).min(axis=1)
    return tuple(v.tolist())


@functools.cache
def _step(symbol: str, after: Vector) -> tuple[Vector, tuple[tuple[str, int], ...]]:
    """For one row: costs before it, and per state the edits chosen and the state they lead to.

    ``after`` has its least cost taken off, so few different ones occur.
    """
    before = _before(symbol, 1, after)
    chosen = []
    for q in range(4):
        letters, at = "", q
        while True:
            options = [(c, cost + after[to], to, True) for c, cost, to in _moves(symbol)[at]]
            options.append(("I", INSERT + before[_NEXT[at]], _NEXT[at], False))
            letter, _, to, done = min(o for o in options if o[1] == before[at])
            letters, at = letters + letter, to
            if done:
                break
        chosen.append((letters, at))
    return before, tuple(chosen)


def _less(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least for x in v), least


def unroll(symbols: str, after: Vector) -> tuple[Vector, list[tuple[tuple[str, int], ...]]]:
    """Costs before the first row, and every row's choices by state."""
    runs = _runs(symbols)
    ends = [after]
    for symbol, count in reversed(runs[1:]):  # costs at the runs' borders
        ends.append(_before(symbol, count, ends[-1]))
    ends.reverse()
    choices: list[tuple[tuple[str, int], ...]] = []
    for (symbol, count), end in zip(runs, ends, strict=True):
        v, inner = _less(end)[0], []
        for _ in range(count):
            before, chosen = _step(symbol, v)
            inner.append(chosen)
            v = _less(before)[0]
        choices.extend(reversed(inner))
    first = _before(*runs[0], ends[0]) if runs else after
    return first, choices


def last_inserts(q: int) -> str:
    """Insertions that end a conversation in state ``q``."""
    out = ""
    while END[q]:
        out, q = out + "I", _NEXT[q]
    return out


# --- rows -------------------------------------------------------------------


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANK))


def _digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def conversation_key(conv_id: Column) -> Column:
    """The id as text, never null."""
    return F.coalesce(F.concat(F.lit("i"), conv_id.cast("string")), F.lit("n"))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with known faults, chosen by a checksum of id and turn.

    Of twenty checksums 0 drops the row, 1 empties its text, 2 removes the ends of
    its sentences, 3 repeats it, 4 makes it the user's. Nulls are one space.
    """
    blank = F.lit(" ")
    part = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")), F.lit(20))
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return (
        rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("__kind"))
        .filter("__kind <> 0")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("__kind") == 1, "")
            .when(F.col("__kind") == 2, F.translate("text", ".!?", ""))
            .otherwise(F.col("text"))
            .alias("text"),
        )
    )


def _faults() -> tuple[Column, Column, Column]:
    """(blank, truncated, symbol without regard to repeats) of a row."""
    end = _trimmed(F.col("text"))
    blank = end == ""
    truncated = ~blank & ~F.substring(end, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(blank, "x").when(truncated, F.upper(role)).otherwise(role)
    return blank, truncated, symbol


def _numbered(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows with key, number, chunk, digest and symbol, in one range sort."""
    blank, truncated, symbol = _faults()
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    plain = rows.select(
        conversation_key(F.col("conv_id")).alias("ck"), "turn", role.alias("role"), text.alias("text")
    ).select(
        "*",
        _digest(F.col("role"), F.col("text")).alias("digest"),
        (64 + F.octet_length("role") + F.octet_length("text")).cast("long").alias("size"),
        blank.alias("blank"),
        truncated.alias("truncated"),
        symbol.alias("symbol"),
        F.monotonically_increasing_id().alias("spot"),  # deals out copies of one row
    )
    order = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spot")]
    found = ordering.placed(ordering.in_order(plain, "ck", order, "size", "turns"), "ck", "size")
    return found.select(
        "ck", "turn", "role", "text", "digest", "blank", "truncated", "symbol",
        F.col(ordering.NTH).alias("pos"),
        F.floor(F.col(ordering.BEFORE) / chunk_bytes).cast("long").alias("chunk"),
    )


# --- conversations of many chunks -------------------------------------------


def _fold(values: list, kind: str) -> list[int]:
    """Product of matrices, or composition of functions."""
    if kind == "cost":
        out = functools.reduce(_times, [np.array(v, dtype=np.int64).reshape(4, 4) for v in values])
        return out.ravel().tolist()
    return functools.reduce(lambda f, g: [g[x] for x in f], [list(v) for v in values])


def _spread(values: list, start: list[int], kind: str) -> list[list[int]]:
    """What meets each value: costs from the right, or the state from the left."""
    if kind == "cost":
        out, v = [], np.array(start, dtype=np.int64)
        for m in reversed(values):
            out.append(v.tolist())
            v = (np.array(m, dtype=np.int64).reshape(4, 4) + v).min(axis=1)
        return out[::-1]
    out, q = [], start[0]
    for f in values:
        out.append([q])
        q = int(f[q])
    return out


def _scan(rows: DataFrame, kind: str, start: list[int]) -> DataFrame:
    """(ck, at, value, met): each value of a key with all that lies beyond or before it.

    No task sees more than ``_FAN`` values of a key at a time.
    """
    schema = "ck string, at bigint, value array<bigint>, met array<bigint>"

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        first = [int(x) for x in pdf["start"].iloc[0]]
        pdf["met"] = _spread(list(pdf["value"]), first, kind)
        return pdf[["ck", "at", "value", "met"]]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        first = pdf.iloc[0]
        return pd.DataFrame({"ck": [first["ck"]], "at": [int(first["up"])], "value": [_fold(list(pdf["value"]), kind)]})

    most = rows.agg(F.max("at")).first()[0]
    up = rows.withColumn("up", F.floor(F.col("at") / _FAN).cast("long"))
    if most is None or most < _FAN:
        begun = up.withColumn("start", F.array(*[F.lit(x).cast("long") for x in start]))
    else:
        above = materialise(
            up.groupBy("ck", "up").applyInPandas(fold, "ck string, at bigint, value array<bigint>"), "above"
        )
        met = _scan(above, kind, start).select("ck", F.col("at").alias("up"), F.col("met").alias("start"))
        begun = up.join(met, ["ck", "up"])
    return materialise(begun.groupBy("ck", "up").applyInPandas(spread, schema), f"met-{kind}")


def _long_chunks(rows: DataFrame) -> DataFrame:
    """(ck, chunk, final) of all conversations with more than one chunk."""
    chunks = rows.groupBy("ck", "chunk").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "band", F.floor(F.col("chunk") / _FAN).cast("long")
    )
    bands = chunks.groupBy("ck", "band").agg(F.max("chunk").alias("last"), F.count(F.lit(1)).alias("n"))
    long = bands.groupBy("ck").agg(F.sum("n").alias("n"), F.max("last").alias("final_chunk")).filter("n > 1")
    held = bands.select("ck", "band").join(long.drop("n"), "ck")
    return materialise(
        chunks.join(held, ["ck", "band"]).select(
            "ck", "chunk", (F.col("chunk") == F.col("final_chunk")).alias("final"), "band"
        ),
        "long",
    )


def _chunk_symbols(rows: DataFrame, long: DataFrame, repeats: DataFrame) -> DataFrame:
    """(ck, at, symbols): the symbols of each long conversation's chunks; ``at`` has no gaps."""
    symbol = F.when(F.col("again").isNotNull(), "x").otherwise(F.col("symbol"))
    marked = (
        rows.select("ck", "chunk", "pos", "symbol")
        .join(long.select("ck", "chunk"), ["ck", "chunk"])
        .join(repeats.select("ck", "pos", F.lit(True).alias("again")), ["ck", "pos"], "left")
        .select("ck", "chunk", "pos", symbol.alias("symbol"))
    )
    cells = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    return marked.groupBy("ck", "chunk").agg(
        F.array_join(F.transform(cells, lambda c: c["symbol"]), "").alias("symbols")
    )


def _solve_chunks(rows: DataFrame, long: DataFrame, repeats: DataFrame) -> DataFrame:
    """(ck, chunk, costs at its end, state at its start, final) of long conversations."""
    symbols = materialise(_chunk_symbols(rows, long, repeats), "symbols")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = [matrix(s).ravel().tolist() for s in pdf["symbols"]]
            yield pd.DataFrame({"ck": pdf["ck"], "at": pdf["chunk"], "value": value})

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            value = []
            for s, met in zip(pdf["symbols"], pdf["met"], strict=True):
                states = [0, 1, 2, 3]
                for chosen in unroll(s, tuple(int(x) for x in met))[1]:
                    states = [chosen[q][1] for q in states]
                value.append(states)
            yield pd.DataFrame({"ck": pdf["ck"], "at": pdf["chunk"], "value": value})

    shape = "ck string, at bigint, value array<bigint>"
    costs = _scan(materialise(symbols.mapInPandas(matrices, shape), "matrices"), "cost", list(END))
    costs = costs.select("ck", F.col("at").alias("chunk"), "met")
    told = materialise(symbols.join(costs, ["ck", "chunk"]).mapInPandas(functions, shape), "states")
    states = _scan(told, "state", [0]).select("ck", F.col("at").alias("chunk"), F.col("met")[0].alias("state"))
    return costs.join(states, ["ck", "chunk"]).join(long.select("ck", "chunk", "final"), ["ck", "chunk"])


# --- unrolling --------------------------------------------------------------

_CHUNK = pa.schema(
    [
        ("ck", pa.string()), ("chunk", pa.int64()), ("whole", pa.bool_()),
        *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        ("first", pa.string()), ("last", pa.string()), ("audit", pa.large_string()),
        ("repaired_sha256", pa.string()), ("repaired", pa.large_string()),
    ]
)
_CHUNK_DDL = (
    "ck string, chunk bigint, whole boolean, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, first string, last string, audit string, "
    "repaired_sha256 string, repaired string"
)
_LEGAL = frozenset(("su", "ua", "au"))


class _Chunk:
    """The rows of one chunk, as they stream in."""

    def __init__(self, ck: str, chunk: int):
        self.ck, self.chunk = ck, chunk
        self.info: dict | None = None
        self.rows: list[tuple] = []

    def solved(self) -> dict:
        info = self.info or {}
        whole = info.get("met") is None
        repeats = set(info.get("repeats") or ())
        symbols = "".join("x" if pos in repeats else symbol for pos, _, _, symbol, _, _ in self.rows)
        costs, choices = unroll(symbols, END if whole else tuple(info["met"]))
        state = 0 if whole else info["state"]
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": costs[state]}
        audit, lines, last = [], [], None
        for (pos, role, text, _, blank, truncated), chosen in zip(self.rows, choices, strict=True):
            again = pos in repeats
            counts["blank"] += blank
            counts["duplicate"] += again and not blank
            counts["truncated"] += truncated and not again
            initial = role[:1]
            counts["illegal"] += last is not None and last + initial not in _LEGAL
            last = initial
            letters, to = chosen[state]
            for letter in letters:
                if letter == "I":
                    state = _NEXT[state]
                    lines.append(_NAME[state] + ":")
                elif letter == "K":
                    lines.append(f"{role}:{text}")
                elif letter == "R":
                    lines.append(f"{_NAME[to]}:{text}")
            state = to
            audit.append(letters)
        if whole or info["final"]:
            more = last_inserts(state)
            audit.append(more)
            for _ in more:
                state = _NEXT[state]
                lines.append(_NAME[state] + ":")
        repaired = "\n".join(lines)
        return {
            "ck": self.ck, "chunk": self.chunk, "whole": whole, **{k: int(v) for k, v in counts.items()},
            "first": self.rows[0][1][:1], "last": last, "audit": "".join(audit),
            "repaired_sha256": hashlib.sha256(repaired.encode("utf-8", "surrogatepass")).hexdigest() if whole else None,
            # every line ends in a line feed, so that no line and an empty one differ
            "repaired": None if whole else "".join(x + "\n" for x in lines),
        }


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk, from the chunk's notes (first, if any) and its rows in order."""
    now: _Chunk | None = None
    done: list[dict] = []
    held = 0
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or (row["ck"], row["chunk"]) != (now.ck, now.chunk):
                if now:
                    done.append(now.solved())
                    held += len(done[-1]["repaired"] or "") + len(done[-1]["audit"])
                now = _Chunk(row["ck"], row["chunk"])
            if row["kind"] == 0:
                now.info = row
            else:
                now.rows.append(
                    (row["pos"], row["role"], row["text"], row["symbol"], row["blank"], row["truncated"])
                )
            if len(done) >= 2_000 or held > 4 << 20:
                yield pa.RecordBatch.from_pylist(done, schema=_CHUNK)
                done, held = [], 0
    if now:
        done.append(now.solved())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_CHUNK)


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Long conversations from their chunks in order; texts only pass a hasher."""
    names = ["ck", *_COUNTS, "audit", "repaired_sha256"]
    schema = pa.schema([_CHUNK.field(n) for n in names])
    now: dict | None = None
    hasher, pending, audit = hashlib.sha256(), b"", []

    def closed() -> pa.RecordBatch:
        row = {k: now[k] for k in ("ck", *_COUNTS)} | {"audit": "".join(audit)}
        return pa.RecordBatch.from_pylist([row | {"repaired_sha256": hasher.hexdigest()}], schema=schema)

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if now is None or now["ck"] != row["ck"]:
                if now:
                    yield closed()
                now, hasher, pending, audit = row, hashlib.sha256(), b"", []
            else:
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    now[k] += row[k]
                now["illegal"] += now["last"] + row["first"] not in _LEGAL
                now["last"] = row["last"]
            audit.append(row["audit"])
            if row["repaired"]:  # the last line feed is held back until a line follows
                hasher.update(pending + row["repaired"][:-1].encode("utf-8", "surrogatepass"))
                pending = b"\n"
    if now:
        yield closed()


def repair(rows: DataFrame, chunk_bytes: int = 1 << 15) -> DataFrame:
    """Per conversation that has rows: faults, cost, audit and the repaired text's hash.

    ``rows`` has conv_id, turn, role and text. Columns: conv_id as ``ck`` (see
    ``conversation_key``), gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.
    """
    numbered = materialise(_numbered(rows, chunk_bytes), "numbered")
    firsts = numbered.groupBy("ck", "digest").agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))
    repeats = materialise(
        numbered.select("ck", "chunk", "pos").join(firsts.select("ck", "pos"), ["ck", "pos"], "left_anti"),
        "repeats",
    )
    per_chunk = repeats.groupBy("ck", "chunk").agg(F.collect_list("pos").alias("repeats"))
    long = _long_chunks(numbered)
    nothing = long.isEmpty()
    if nothing:
        notes = per_chunk.select(
            "ck", "chunk", "repeats", F.lit(None).cast("array<bigint>").alias("met"),
            F.lit(None).cast("bigint").alias("state"), F.lit(None).cast("boolean").alias("final"),
        )
    else:
        notes = per_chunk.join(materialise(_solve_chunks(numbered, long, repeats), "solved"), ["ck", "chunk"], "full")
    row_part = numbered.select(
        "ck", "chunk", F.lit(1).alias("kind"), "pos", "role", "text", "symbol", "blank", "truncated"
    )
    streamed = (
        row_part.unionByName(notes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        .repartition("ck", "chunk")
        .sortWithinPartitions("ck", "chunk", "kind", "pos")
        .mapInArrow(_unrolled, _CHUNK_DDL)
    )
    names = ["ck", *_COUNTS, "audit", "repaired_sha256"]
    if nothing:
        solved = streamed.select(*names)
    else:
        streamed = materialise(streamed, "unrolled")
        ddl = "ck string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
        chunks = streamed.filter("not whole").repartition("ck").sortWithinPartitions("ck", "chunk")
        solved = streamed.filter("whole").select(*names).unionByName(chunks.mapInArrow(_joined, ddl))
    turns = numbered.groupBy("ck", "turn").agg(F.count(F.lit(1)).alias("n"))
    wide = lambda c: c.cast("decimal(20,0)")  # noqa: E731  differences of any two longs
    gaps = turns.groupBy("ck").agg(
        F.coalesce(
            (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).cast("long"), F.lit(0)
        ).alias("gaps")
    )
    return solved.join(gaps, "ck").select("ck", "gaps", *names[1:])


def repair_all(rows: DataFrame, ids: DataFrame, chunk_bytes: int = 1 << 15) -> DataFrame:
    """``repair`` with a row for every conv_id of ``ids``, also those without rows."""
    every = ids.select("conv_id").distinct().withColumn("ck", conversation_key(F.col("conv_id")))
    found = repair(rows, chunk_bytes)
    zeros = ("gaps", *_COUNTS)
    return every.join(found, "ck", "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
