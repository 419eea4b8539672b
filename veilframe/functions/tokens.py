"""Signed replacement tokens: ``__PII_{type}_{16 hex id}_{16 hex signature}__``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.crypto import hmac_sha256

# --- fixed values: token format -----------------------------------------------
TOKEN_PREFIX = "__PII_"
TOKEN_SUFFIX = "__"
# --- end of fixed values ------------------------------------------------------

# A type is at most 64 characters and holds no further prefix, so adjacent
# tokens and a fake prefix in front of a real token are told apart. Detectors with
# other types are refused by ``check_type`` when they are built.
TOKEN_PATTERN = (
    r"__PII_(?:(?!__PII_)[a-zA-Z0-9_]){1,64}?_[0-9a-f]{16}_[0-9a-f]{16}__"
)


_TYPE = re.compile(r"(?:(?!__PII_)[a-zA-Z0-9_]){1,64}")


def check_type(type_: str) -> str:
    """The type if tokens can carry it; otherwise an error."""
    if not _TYPE.fullmatch(type_) or type_.startswith("_PII_"):
        raise ValueError(f"not a usable type: {type_!r} (1 to 64 letters, digits, underscores)")
    return type_


def _scoped(scope: Column) -> Column:
    """Length-prefixed scope: no two scopes frame to the same text."""
    return F.concat(F.octet_length(scope).cast("string"), F.lit(":"), scope)


def mint_token(scope: Column, type_: Column, value: Column) -> Column:
    """The token of a value in a scope: the same on every run and retry."""
    ident = F.substring(
        hmac_sha256(F.concat(F.lit("id:"), _scoped(scope), type_, F.lit(":"), value)), 1, 16
    )
    return F.concat(
        F.lit(TOKEN_PREFIX), type_, F.lit("_"), ident, F.lit("_"),
        signature(scope, type_, ident), F.lit(TOKEN_SUFFIX),
    )


def signature(scope: Column, type_: Column, ident: Column) -> Column:
    message = F.concat(F.lit("sig:"), _scoped(scope), type_, F.lit(":"), ident)
    return F.substring(hmac_sha256(message), 1, 16)


def parse_token(token: Column) -> Column:
    """``struct<type,id,sig>``: the last two parts are id and signature; NULL if malformed."""
    form = "^__PII_(.+)_([^_]+)_([^_]+)__$"
    part = lambda k: F.regexp_extract(token, form, k)
    return F.when(
        token.rlike(form),
        F.struct(part(1).alias("type"), part(2).alias("id"), part(3).alias("sig")),
    )


def token_verifies(scope: Column, token: Column) -> Column:
    """True when the signature was made with this key for this scope and type."""
    p = parse_token(token)
    return F.coalesce(signature(scope, p["type"], p["id"]) == p["sig"], F.lit(False))
