"""Chunked text as a stream.

What is kept of a stream is only the text after the last place no match can
straddle; everything before it leaves as a unit and is scanned by the same
column expressions as a batch table. Many streams share a state, so that Python
is called per bucket of streams. Python sees chunk borders, not values.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.config import CHUNK_TAIL_CHARS, ScanConfig
from veilframe.functions.crypto import Keyring, decrypt, with_keys, without_keys
from veilframe.functions.spans import let
from veilframe.functions.tokens import TOKEN_PATTERN, token_verifies
from veilframe.operators.detect import glue_of, never_of
from veilframe.operators.redact import redact
from veilframe.operators.restore import rehydrate, substitute
from veilframe.sources.workdir import materialise
from veilframe.streaming.order import Held, rejected

SEQUENCED_SCHEMA = "stream_id string, at bigint, text string, seq bigint, reason string"
VALUED_SCHEMA = (
    "stream_id string, at bigint, text string, "
    "entries array<struct<token:string,ciphertext:string>>, complete boolean"
)
WINDOW_SCHEMA = "stream_id string, seq bigint, window string, overlap int"


def _python_class(glue: str) -> str:
    return f"[^\\t\\n\\f\\r {re.escape(''.join(sorted(set(glue))))}]"


def value_cut(glue: str, never: str = "") -> str:
    """Pattern whose last match ends where no detected value can straddle."""
    here = _python_class(glue) + r"(?=[\t\n\f\r ])"
    return f"(?:{here}|(?=[{re.escape(never)}]))" if never else here


# A token consists of word characters, so any other character ends one.
TOKEN_CUT = r"[^0-9A-Za-z_]"


def _last_cut(text: str, cut: re.Pattern, known: int) -> int:
    """End of the last match, searching only what has not been searched before."""
    end = 0
    for m in cut.finditer(text, max(known - 1, 0)):
        end = m.end()
    return end


def _milliseconds(times: list) -> list[int | None]:
    return [None if pd.isna(t) else int(pd.Timestamp(t).timestamp() * 1000) for t in times]


def _news(frames: Iterator[pd.DataFrame]) -> dict[str | None, list[tuple]]:
    """By stream, what came: (seq, chunk, is_last, milliseconds), and token, ciphertext if there are such."""
    came: dict[str | None, list[tuple]] = {}
    for batch in frames:
        ms = _milliseconds(batch["ts"].tolist()) if "ts" in batch else [None] * len(batch)
        more = [batch[c].tolist() for c in ("token", "ciphertext") if c in batch]
        rows = zip(batch["seq"].tolist(), batch["chunk"].tolist(), batch["is_last"].tolist(), ms, *more, strict=True)
        for stream, row in zip(batch["stream_id"].tolist(), rows, strict=True):
            came.setdefault(stream, []).append(row)
    return came


def _in_order(rows: list[tuple]) -> list[tuple]:
    return sorted((r[:4] for r in rows), key=lambda r: int(r[0]))


def _frame(rows: list[tuple], columns: tuple[str, ...], whole: tuple[str, ...]) -> pd.DataFrame:
    """Rows as a frame; ``whole`` are numbers that may be missing. Made once per bucket and batch, so column by column."""
    each = dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))
    return pd.DataFrame({c: pd.array(v, "Int64") if c in whole else pd.Series(v, dtype=object) for c, v in each.items()})


def _cut_units(held: Held, pattern: re.Pattern, patience: int | None, give_up: bool) -> list[tuple[int, str]]:
    """Units that can leave, by what the sequence has ready."""
    units = []

    def take() -> None:
        parts = [chunk for _, chunk in held.sequence.ready() if chunk]
        known = len(held.text)
        held.text = "".join([held.text, *parts])
        end = len(held.text) if held.sequence.finished else _last_cut(held.text, pattern, known)
        if end:
            units.append(held.release(end))

    take()
    while (give_up or held.sequence.overdue(patience)) and held.sequence.waiting:
        if held.text:  # nothing can span a gap
            units.append(held.release(len(held.text)))
        held.sequence.skip()
        take()
    if give_up and held.text:
        units.append(held.release(len(held.text)))
    return units


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


#: States of a query. Streams are dealt to them, so a micro-batch calls Python so many
#: times at most, however many streams there are; fixed for the life of a checkpoint.
BUCKETS = 1024
Step = Callable[[str | None, list[tuple] | None, str | None], tuple[str | None, list[tuple]]]


def _stepped(
    news: DataFrame, step: Step, schema: str, whole: tuple[str, ...], idle_ms: int | None, buckets: int
) -> DataFrame:
    """Run ``step`` once per micro-batch and stream with news, or without any for ``idle_ms``.

    ``step`` takes the stream, its rows (None: it is idle) and what it kept, and gives
    what to keep (None: nothing) and its output rows. A state holds what all streams of
    a bucket keep, each with the time from which it is idle; streams without news are
    passed on as they are.
    """
    names = tuple(T.StructType.fromDDL(schema).names)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs() if idle_ms else 0
        kept = {s: (held, until) for s, held, until in json.loads(state.get[0])} if state.exists else {}
        came = _news(frames)
        idle = [s for s, (_, until) in kept.items() if idle_ms and until < now and s not in came]
        rows: list[tuple] = []
        for stream in [*came, *idle]:
            held, out = step(stream, came.get(stream), kept.pop(stream, (None, 0))[0])
            rows += out
            if held is not None:
                kept[stream] = held, now + (idle_ms or 0)
        if kept:
            state.update((json.dumps([(s, held, until) for s, (held, until) in kept.items()]),))
            if idle_ms:
                state.setTimeoutDuration(max(1, min(until for _, until in kept.values()) - now))
        else:
            state.remove()
        if rows:
            yield _frame(rows, names, whole)

    dealt = news.withColumn("_bucket", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)))
    return dealt.groupBy("_bucket").applyInPandasWithState(
        run, schema, "held string", "append", _timeout(idle_ms)
    )


def sequenced(
    chunks: DataFrame, cut: str, idle_ms: int | None = None, patience_ms: int | None = None,
    keep_ends: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Chunks ``stream_id, seq, chunk, is_last`` (and ``ts``) to ``stream_id, at, text, seq, reason``.

    Rows without a reason are units, which concatenate to the stream: ``seq`` counts
    from 0, and a chunk is taken when all before it have been, in whatever order and
    micro-batch they come. ``is_last`` releases the rest. A chunk waits for missing
    ones for ``patience_ms`` of the stream's event time (its latest ``ts``), or until
    nothing has come for ``idle_ms``; then the text goes on after the gap, as if
    the missing chunks were empty. Rows with a reason were refused: ``repeated`` (their
    place is taken, or beyond the end) or ``late`` (they were given up before). Their
    text is their own, their ``at`` null.

    Kept of a stream is the text after the last cut and the chunks that wait. It goes
    at the end of the stream or, with ``keep_ends``, outlives it, so that repeats are
    still known as such: until nothing has come for ``idle_ms``, or as long as the query
    runs. A query with ``idle_ms`` always has another micro-batch to look for idle
    streams, so it does not end by itself (``availableNow``).

    Streams share ``buckets`` states; a state is rewritten when one of its streams has news.
    """

    pattern = re.compile(cut)

    def step(stream: str | None, came: list[tuple] | None, kept: str | None) -> tuple[str | None, list[tuple]]:
        held, idle = Held.load(kept), came is None
        refused = [] if idle else rejected(_in_order(came), held.sequence)
        units = _cut_units(held, pattern, patience_ms, idle)
        rows = [(stream, at, text, None, None) for at, text in units]
        rows += [(stream, None, text, seq, why) for seq, text, why in refused]
        ends = idle or (held.sequence.finished and not keep_ends)
        return None if ends else held.dump(), rows

    return _stepped(chunks, step, SEQUENCED_SCHEMA, ("at", "seq"), idle_ms, buckets)


def hold_back(
    chunks: DataFrame, cut: str, idle_ms: int | None = None, patience_ms: int | None = None,
    keep_ends: bool = False,
) -> DataFrame:
    """The units of ``sequenced`` alone, ``stream_id, at, text``."""
    units = sequenced(chunks, cut, idle_ms, patience_ms, keep_ends)
    return units.filter("reason is null").select("stream_id", "at", "text")


def _value_cut(cfg: ScanConfig) -> str:
    glue = glue_of(cfg)
    if glue is None:
        raise ValueError("stream redaction needs detectors with known glue")
    return value_cut(glue, never_of(cfg))


def redact_stream(
    chunks: DataFrame, cfg: ScanConfig, keys: Keyring, idle_ms: int | None = None,
    patience_ms: int | None = None, keep_ends: bool = False,
) -> DataFrame:
    """Redact a chunk stream; a value split over chunks is found whole, in whatever order they come."""
    units = hold_back(chunks, _value_cut(cfg), idle_ms, patience_ms, keep_ends)
    return redact(units, "text", "stream_id", cfg, keys)


def redact_stream_with_rejects(
    chunks: DataFrame, cfg: ScanConfig, keys: Keyring, idle_ms: int | None = None,
    patience_ms: int | None = None, keep_ends: bool = False,
) -> DataFrame:
    """``redact_stream`` with the refused chunks as rows of their own (``seq, reason``), redacted too."""
    rows = sequenced(chunks, _value_cut(cfg), idle_ms, patience_ms, keep_ends)
    return redact(rows, "text", "stream_id", cfg, keys)


def rehydrate_stream(
    chunks: DataFrame, vault: Callable[[], DataFrame], keys: Keyring, write: Callable[[DataFrame, int], None],
    idle_ms: int | None = None,
):
    """Restore tokens in a chunk stream; returns a started-by-caller writer.

    Each micro-batch joins the vault as it is then (``vault`` is called per
    batch) and hands ``stream_id, at, restored`` to ``write``. Its units are stored
    first: restoring reads them twice, and the state is stepped once.
    """
    units = hold_back(chunks, TOKEN_CUT, idle_ms)

    def restore(batch: DataFrame, epoch: int) -> None:
        stored = materialise(batch, "units")
        done = rehydrate(stored, "text", "stream_id", ["stream_id", "at"], vault(), keys)
        write(done.select("stream_id", "at", "restored"), epoch)

    return units.writeStream.foreachBatch(restore)


def _wait_for_values(patience_ms: int | None) -> Step:
    """Step over chunks and vault entries of one stream."""
    cut, token = re.compile(TOKEN_CUT), re.compile(TOKEN_PATTERN)

    def step(stream: str | None, came: list[tuple] | None, kept: str | None) -> tuple[str | None, list[tuple]]:
        raw = json.loads(kept) if kept is not None else {"held": None, "vault": {}, "units": []}
        held, vault, units, idle = Held.load(raw["held"]), raw["vault"], raw["units"], came is None
        if not idle:
            vault.update((r[4], r[5]) for r in came if r[4] is not None)
            rejected(_in_order([r for r in came if r[4] is None]), held.sequence)
        for at, text in _cut_units(held, cut, patience_ms, idle):
            units.append([at, text, held.sequence.clock])
        rows, waiting = [], []
        for at, text, since in units:
            tokens = dict.fromkeys(token.findall(text))
            known = [(t, vault[t]) for t in tokens if t in vault]
            clock = held.sequence.clock
            tired = patience_ms is not None and since is not None and since + patience_ms < clock
            if len(known) == len(tokens) or tired or idle:
                entries = [{"token": t, "ciphertext": c} for t, c in known]
                rows.append((stream, at, text, entries, len(known) == len(tokens)))
            else:
                waiting.append([at, text, since])
        if idle:
            return None, rows
        return json.dumps({"held": held.dump(), "vault": vault, "units": waiting}), rows

    return step


def rehydrate_with_vault_stream(
    chunks: DataFrame, vault: DataFrame, keys: Keyring, idle_ms: int | None = None,
    patience_ms: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """Restore a chunk stream from a vault that is a stream as well: ``stream_id, at, restored, complete``.

    ``vault`` has scope_id, token and ciphertext; scopes are streams. A piece of text
    leaves once the vault entries of all its tokens have come, from whichever side
    they come first, so a token that is seen before its value is restored as well.
    One whose entry never comes is let go, unrestored and not ``complete``, after
    ``patience_ms`` of the stream's event time or ``idle_ms`` without news of the
    stream, which also ends its state (without ``idle_ms`` it stays as long as the query
    runs). Python sees tokens and ciphertexts; signatures
    are checked and values decrypted by column expressions.
    """
    given = {f.name for f in chunks.schema.fields}
    ts = F.col("ts") if "ts" in given else F.lit(None).cast("timestamp")
    news = chunks.select(
        "stream_id", "seq", "chunk", "is_last", ts.alias("ts"),
        F.lit(None).cast("string").alias("token"), F.lit(None).cast("string").alias("ciphertext"),
    ).unionByName(
        vault.select(
            F.col("scope_id").alias("stream_id"), F.lit(None).cast("bigint").alias("seq"),
            F.lit(None).cast("string").alias("chunk"), F.lit(False).alias("is_last"),
            F.lit(None).cast("timestamp").alias("ts"), "token",
            F.base64("ciphertext").alias("ciphertext"),
        )
    )
    held = _stepped(news, _wait_for_values(patience_ms), VALUED_SCHEMA, ("at",), idle_ms, buckets)
    scope = F.col("stream_id")
    good = F.filter("entries", lambda e: token_verifies(scope, e["token"]))
    values = F.map_from_entries(
        F.transform(good, lambda e: F.struct(e["token"], decrypt(F.unbase64(e["ciphertext"]), scope, e["token"])))
    )
    done = with_keys(held, keys).withColumn("_values", values)
    return without_keys(done.withColumn("restored", substitute(F.col("text"), F.col("_values")))).select(
        "stream_id", "at", "restored", "complete"
    )


def overlap_windows(
    chunks: DataFrame, chars: int = CHUNK_TAIL_CHARS, idle_ms: int | None = None,
    patience_ms: int | None = None, keep_ends: bool = False, buckets: int = BUCKETS,
) -> DataFrame:
    """Every chunk with the last ``chars`` characters before it in front.

    Gives ``stream_id, seq, window, overlap``; ``is_last`` emits the held tail as a
    final window with ``seq`` NULL. Chunks are taken in order of ``seq``, as in
    ``sequenced``; nothing goes over a gap, and refused chunks give no window.
    """

    def step(stream: str | None, came: list[tuple] | None, kept: str | None) -> tuple[str | None, list[tuple]]:
        held, idle = Held.load(kept), came is None
        sequence, done, out = held.sequence, held.sequence.finished, []
        if not idle:
            rejected(_in_order(came), sequence)

        def take() -> None:
            for seq, chunk in sequence.ready():
                window = held.text + chunk
                out.append((stream, seq, window, len(held.text)))
                held.text = window[-chars:]

        take()
        while (idle or sequence.overdue(patience_ms)) and sequence.waiting:
            held.text = ""
            sequence.skip()
            take()
        if (sequence.finished or idle) and not done:
            out.append((stream, None, held.text, len(held.text)))
            held.text = ""
        return None if idle or (sequence.finished and not keep_ends) else held.dump(), out

    return _stepped(chunks, step, WINDOW_SCHEMA, ("seq", "overlap"), idle_ms, buckets)


def numbered_chunks(texts: DataFrame, stream: str, text: str, chars: int) -> DataFrame:
    """Cut whole texts into the chunk rows the operators above read."""
    cut = F.regexp_extract_all(F.col(text), F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))
    # a text is cut once: each chunk carries whether it is the last
    marked = let(cut, lambda c: F.transform(c, lambda t, i: F.struct(t.alias("chunk"), (i == F.size(c) - 1).alias("is_last"))))
    rows = texts.select(
        F.col(stream).cast("string").alias("stream_id"), F.posexplode_outer(marked).alias("seq", "_c")
    ).filter("_c is not null")
    return rows.select("stream_id", F.col("seq").cast("bigint").alias("seq"), "_c.chunk", "_c.is_last")
