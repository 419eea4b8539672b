"""Chat-API bodies: pull out the texts worth scanning, put redacted ones back.

A format is a list of paths per direction. A body is parsed as a variant
for what lies at these paths; a content may be a string or a list of parts. To
rebuild it, only the JSON strings whose text has changed are rewritten, so every
other field, number and blank stays as it was. JSON of another shape is scanned
in all its string values, decoded before and encoded after; what isn't JSON at all
is raw text. All of it stays inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ROUTES, ScanConfig
from veilframe.functions.crypto import Keyring, with_keys, without_keys
from veilframe.functions.spans import let
from veilframe.functions.tokens import TOKEN_PATTERN, TOKEN_PREFIX
from veilframe.operators.redact import REDACTED_SPANS_TYPE, redact_column

FIELDS_TYPE = "array<struct<path:string,text:string>>"
RAW = "raw"


@dataclass(frozen=True)
class BodyFormat:
    """Where texts are; ``*`` stands for every array element."""

    paths: tuple[str, ...]


@dataclass(frozen=True)
class ChatFormat:
    request: BodyFormat
    response: BodyFormat

    def side(self, direction: str) -> BodyFormat:
        if direction not in ("request", "response"):
            raise ValueError(f"direction must be request or response, not {direction!r}")
        return self.request if direction == "request" else self.response


# --- fixed values: where the texts are ----------------------------------------
_CHAT_COMPLETIONS = ChatFormat(
    request=BodyFormat(("messages.*.content",)),
    response=BodyFormat(("choices.*.message.content", "error.message")),
)
FORMATS: Mapping[str, ChatFormat] = {
    "openai": _CHAT_COMPLETIONS,
    "azure": _CHAT_COMPLETIONS,
    "anthropic": ChatFormat(
        request=BodyFormat(("system", "messages.*.content")),
        response=BodyFormat(("content.*.text", "error.message")),
    ),
    "gemini": ChatFormat(
        request=BodyFormat(("systemInstruction.parts.*.text", "contents.*.parts.*.text")),
        response=BodyFormat(("candidates.*.content.parts.*.text", "error.message")),
    ),
}
# --- end of fixed values ------------------------------------------------------

Formats = Mapping[str, ChatFormat]


def format_of(name: str, formats: Formats = FORMATS) -> ChatFormat:
    if name not in formats:
        raise ValueError(f"unknown provider: {name}")
    return formats[name]


# --- texts of a body ----------------------------------------------------------


def _nothing() -> Column:
    return F.array().cast(FIELDS_TYPE)


def _kind(node: Column) -> Column:
    """``STRING``, ``OBJECT<...>``, ``ARRAY<...>``, ``VOID`` and so on; VOID if missing."""
    return F.coalesce(F.schema_of_variant(node), F.lit("VOID"))


def _is(kind: Column, name: str) -> Column:
    return F.startswith(kind, F.lit(name))


def _items(node: Column) -> Column:
    return F.try_variant_get(node, "$", "array<variant>")


def _member(node: Column, names: list[str]) -> Column:
    return F.try_variant_get(node, "$." + ".".join(names), "variant")


def _step(parts: list[str]) -> tuple[list[str], list[str]]:
    """The names up to the next ``*``, and what follows."""
    n = next((i for i, p in enumerate(parts) if p == "*"), len(parts))
    return parts[:n], parts[n:]


def _one(text: Column, path: Column) -> Column:
    return F.when(
        F.length(text) > 0, F.array(F.struct(path.alias("path"), text.alias("text")))
    ).otherwise(_nothing())


def _string(node: Column, path: Column) -> Column:
    return F.when(_is(_kind(node), "STRING"), _one(node.cast("string"), path)).otherwise(_nothing())


def _leaf(node: Column, path: Column) -> Column:
    """A string, or the strings and ``text`` members of a list of parts."""
    under = lambda i, name="": F.concat(path, F.lit("."), i.cast("string"), F.lit(name))
    parts = F.transform(
        _items(node),
        lambda x, i: F.when(_is(_kind(x), "STRING"), _string(x, under(i))).otherwise(
            _string(_member(x, ["text"]), under(i, ".text"))
        ),
    )
    return F.when(_is(_kind(node), "ARRAY"), F.flatten(parts)).otherwise(_string(node, path))


def _found(node: Column, parts: list[str], path: Column | None = None) -> Column:
    if not parts:
        return _leaf(node, path)
    if parts[0] == "*":
        each = F.transform(
            _items(node),
            lambda x, i: _found(x, parts[1:], F.concat(path, F.lit("."), i.cast("string"))),
        )
        return F.coalesce(F.flatten(each), _nothing())
    names, rest = _step(parts)
    name = F.lit(".".join(names))
    return _found(_member(node, names), rest, name if path is None else F.concat(path, F.lit("."), name))


def _plain(node: Column) -> Column:
    return _kind(node).isin("STRING", "VOID")


def _sound(node: Column, parts: list[str]) -> Column:
    """Whether what lies at a path has the expected shape or is missing."""
    if not parts:
        listed = F.forall(
            _items(node),
            lambda x: _plain(x) | (_is(_kind(x), "OBJECT") & _plain(_member(x, ["text"]))),
        )
        return _plain(node) | (_is(_kind(node), "ARRAY") & listed)
    if parts[0] == "*":
        inner = F.forall(_items(node), lambda x: _sound(x, parts[1:]))
        return (_kind(node) == "VOID") | (_is(_kind(node), "ARRAY") & inner)
    names, rest = _step(parts)
    on_way = reduce(
        and_,
        [_is(_kind(_member(node, names[:i]) if i else node), "OBJECT")
         | (_kind(_member(node, names[:i]) if i else node) == "VOID") for i in range(len(names))],
    )
    return on_way & _sound(_member(node, names), rest)


# --- strings of a body --------------------------------------------------------

# Stand in for escaped backslashes and quotes while a body is cut at its quotes;
# noncharacters, replaced in the rare body that holds them.
_BACKSLASH, _QUOTE = "\ufdd0", "\ufdd1"
_KEY_FOLLOWS = r"\A[ \t\n\r]*:"


def _swapped(text: Column, old: str, new: str) -> Column:
    """``replace`` by a literal pattern: that one compares at every byte."""
    pattern = "".join(f"\\x{{{ord(c):x}}}" for c in old)
    changed = F.regexp_replace(text, pattern, new.replace("\\", "\\\\"))
    return F.when(F.contains(text, F.lit(old)), changed).otherwise(text)


def _cut(body: Column) -> Column:
    """A body cut at the quotes of its strings: strings have odd places."""
    odd = F.contains(body, F.lit(_BACKSLASH)) | F.contains(body, F.lit(_QUOTE))
    safe = F.when(odd, F.translate(body, _BACKSLASH + _QUOTE, "\ufffd\ufffd")).otherwise(body)
    marked = let(safe, lambda t: _swapped(t, "\\\\", _BACKSLASH))
    return let(marked, lambda t: F.split(_swapped(t, '\\"', _QUOTE), '"', -1))


def _joined(cuts: Column) -> Column:
    quoted = let(F.array_join(cuts, '"'), lambda t: _swapped(t, _QUOTE, '\\"'))
    return let(quoted, lambda t: _swapped(t, _BACKSLASH, "\\\\"))


def _decoded(cut: Column) -> Column:
    literal = F.concat(F.lit('["'), _joined(F.array(cut)), F.lit('"]'))
    escaped = cut.rlike(r"[\\" + _BACKSLASH + _QUOTE + "]")
    return F.when(escaped, F.get(F.from_json(literal, "array<string>"), F.lit(0))).otherwise(cut)


def json_string(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    literal = F.to_json(F.array(text))
    return F.substring(literal, F.lit(3), F.length(literal) - 4)


def parsed_body(body: Column) -> Column:
    """The body as a variant, NULL unless all of it is one JSON value.

    Spark's parser stops after the first value. What could follow one in a list
    and what could in an object have only the comma in common, and with that the
    list has two elements: so a body that parses in both is a single value.
    """
    listed = _items(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))))
    member = F.try_parse_json(F.concat(F.lit('{"b":'), body, F.lit("}")))
    one = lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0)))
    return F.when(member.isNotNull(), let(listed, one))


def _all_strings(body: Column) -> Column:
    """Every string value of a JSON text as a field ``json.{place}``; keys are left out."""
    def fields(cuts: Column) -> Column:
        return F.transform(
            F.filter(
                F.sequence(F.lit(1), F.greatest(F.size(cuts) - 2, F.lit(1)), F.lit(2)),
                lambda i: (i < F.size(cuts) - 1) & ~F.get(cuts, i + 1).rlike(_KEY_FOLLOWS),
            ),
            lambda i: F.struct(
                F.concat(F.lit("json."), i.cast("string")).alias("path"),
                _decoded(F.get(cuts, i)).alias("text"),
            ),
        )

    return F.filter(let(_cut(body), fields), lambda f: F.length(f["text"]) > 0)


def extract_text(
    body: Column, provider: str, direction: str = "request", formats: Formats = FORMATS
) -> Column:
    """``array<struct<path,text>>`` of the texts of a body, non-empty ones."""
    paths = [p.split(".") for p in format_of(provider, formats).side(direction).paths]

    def texts(parsed: Column) -> Column:
        known = _is(_kind(parsed), "OBJECT") & reduce(and_, [_sound(parsed, p) for p in paths])
        return (
            F.when(parsed.isNull(), _one(body, F.lit(RAW)))
            .when(known, F.concat(*[_found(parsed, p) for p in paths]))
            .otherwise(_all_strings(body))
        )

    return let(parsed_body(body), texts)


def rebuild(body: Column, changes: Column) -> Column:
    """The body with every string that is a key of ``changes`` replaced by its value.

    Without changes the body comes back as it is. A body that is a key itself (raw
    text) is replaced as a whole.
    """
    def change(cut: Column, i: Column) -> Column:
        new = F.try_element_at(changes, _decoded(cut))
        return F.when((i % 2 == 1) & new.isNotNull(), json_string(new)).otherwise(cut)

    return F.when(F.size(changes) == 0, body).otherwise(
        F.coalesce(F.try_element_at(changes, body), _joined(F.transform(_cut(body), change)))
    )


# --- tables of bodies ---------------------------------------------------------


def by_provider(
    provider: Column, build: Callable[[str], Column], only: tuple[str, ...] = (),
    formats: Formats = FORMATS,
) -> Column:
    """One expression per distinct format, chosen by the row's provider.

    ``only`` leaves out formats a table is known not to hold.
    """
    alike: dict[ChatFormat, list[str]] = {}
    for name in only or formats:
        alike.setdefault(format_of(name, formats), []).append(name)
    chain = None
    for names in alike.values():
        cond, out = provider.isin(*names), build(names[0])
        chain = F.when(cond, out) if chain is None else chain.when(cond, out)
    return chain


def split_known(
    df: DataFrame, provider: str = "provider", formats: Formats = FORMATS
) -> tuple[DataFrame, DataFrame]:
    """Rows whose provider has a format, and the rejected rest with a reason."""
    known = F.coalesce(F.col(provider).isin(*formats), F.lit(False))
    rejected = df.filter(~known).withColumn("reason", F.lit("unknown provider"))
    return df.filter(known), rejected


def extract_fields(
    df: DataFrame, body: str = "body", provider: str = "provider", direction: str = "request",
    only: tuple[str, ...] = (), formats: Formats = FORMATS,
) -> DataFrame:
    """Add ``fields`` for a table that mixes formats, in a single pass."""
    build = lambda name: extract_text(F.col(body), name, direction, formats)
    return df.withColumn("fields", by_provider(F.col(provider), build, only, formats))


def explode_fields(df: DataFrame, *keys: str) -> DataFrame:
    """One row per extracted text."""
    return df.select(*keys, F.inline_outer("fields")).filter(F.col("path").isNotNull())


# Stands for a token of the request while a response is scanned; a noncharacter
# that no pattern matches.
_HELD = "\ufdd2"


def redact_bodies(
    df: DataFrame,
    cfg: ScanConfig,
    keys: Keyring,
    scope: str = "request_id",
    body: str = "body",
    provider: str = "provider",
    direction: str = "request",
    only: tuple[str, ...] = (),
    formats: Formats = FORMATS,
) -> DataFrame:
    """Extract, scan, redact and rebuild, all in the row.

    Adds ``redacted_body`` and ``spans`` (those of all texts, with tokens; offsets
    count from the text's start, a token that was there before as one character).
    Tokens in the texts stay and are not scanned. Without a scope a body with
    anything to hide becomes NULL.
    """
    rows = with_keys(extract_fields(df, body, provider, direction, only, formats), keys)
    # step by step: in one expression the lambdas nest deeper than Spark resolves
    rows = rows.withColumn(
        "_done",
        # the held text in a step of its own: redacting uses it several times
        F.transform(
            F.transform(
                "fields",
                lambda f: F.struct(f["text"].alias("text"), _without_tokens(f["text"]).alias("held")),
            ),
            lambda f: F.struct(
                f["text"].alias("text"), redact_column(f["held"], F.col(scope), cfg).alias("r")
            ),
        ),
    )
    rows = rows.withColumn(
        "_changes",
        F.map_from_entries(
            F.array_distinct(
                F.transform(
                    F.filter("_done", lambda d: F.size(d["r"]["spans"]) > 0),
                    lambda d: F.struct(d["text"], _with_tokens(d["r"]["redacted"], d["text"])),
                )
            )
        ),
    ).withColumn(
        "spans",
        F.coalesce(
            F.flatten(F.transform("_done", lambda d: d["r"]["spans"])),
            F.array().cast(REDACTED_SPANS_TYPE),
        ),
    )
    lost = F.exists("_done", lambda d: d["r"]["redacted"].isNull())
    rows = rows.withColumn("redacted_body", F.when(~lost, rebuild(F.col(body), F.col("_changes"))))
    return without_keys(rows.drop("_done", "_changes", "fields"))


def _without_tokens(text: Column) -> Column:
    """The text with one character in place of each token."""
    held = F.regexp_replace(text, TOKEN_PATTERN, _HELD)
    return F.when(F.contains(text, F.lit(TOKEN_PREFIX)), held).otherwise(text)


def _with_tokens(redacted: Column, text: Column) -> Column:
    """Put the tokens of ``text`` back where they were held."""
    hits = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    parts = F.arrays_zip(F.split(redacted, _HELD, -1).alias("gap"), hits.alias("token"))
    whole = F.array_join(
        F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["token"], F.lit("")))), ""
    )
    return F.when(F.size(hits) > 0, whole).otherwise(redacted)


def route(path: Column, routes=ROUTES) -> Column:
    """The provider of the first prefix that matches, else NULL."""
    chain = None
    for prefix, name in routes:
        cond = F.startswith(path, F.lit(prefix))
        chain = F.when(cond, name) if chain is None else chain.when(cond, name)
    return chain if chain is not None else F.lit(None).cast("string")
