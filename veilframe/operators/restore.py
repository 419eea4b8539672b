"""Restoration: verified tokens back to the values they stand for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.crypto import Keyring, decrypt, framed, with_keys, without_keys
from veilframe.functions.spans import empty, find_all, shift
from veilframe.functions.tokens import TOKEN_PATTERN, TOKEN_PREFIX, token_verifies
from veilframe.operators.chat import FORMATS, Formats, json_string, parsed_body, redact_bodies
from veilframe.operators.redact import REDACTED_SPANS_TYPE, redact_column
from veilframe.sources.workdir import materialise


def has_token(text: Column) -> Column:
    return F.contains(text, F.lit(TOKEN_PREFIX))


def lookup(tokens: DataFrame, vault: DataFrame, keys: Keyring) -> DataFrame:
    """Plain lookup: adds ``value``, NULL for tokens the vault does not hold.

    A token that the vault holds several times (batches may overlap) is one value.
    """
    held = vault.groupBy("scope_id", "token").agg(F.min("ciphertext").alias("ciphertext"))
    joined = tokens.join(held, ["scope_id", "token"], "left")
    value = decrypt(F.col("ciphertext"), F.col("scope_id"), F.col("token"))
    return without_keys(with_keys(joined, keys).withColumn("value", value).drop("ciphertext"))


def verified(tokens: DataFrame, keys: Keyring) -> DataFrame:
    """Only the tokens whose signature holds for their scope and type."""
    good = token_verifies(F.col("scope_id"), F.col("token"))
    return without_keys(with_keys(tokens, keys).filter(good))


def verify_and_lookup(tokens: DataFrame, vault: DataFrame, keys: Keyring) -> DataFrame:
    """Signature check first, then the lookup; forged tokens never reach the vault."""
    return lookup(verified(tokens, keys), vault, keys).filter(F.col("value").isNotNull())


def _contents(text: str, scope: str) -> Column:
    """Names scope and text together; rows alike in both are restored alike."""
    return F.sha2(framed(F.col(scope).cast("string"), F.col(text)).cast("binary"), 256)


def rehydrate(
    df: DataFrame,
    text: str,
    scope: str,
    key: Sequence[str],
    vault: DataFrame,
    keys: Keyring,
    out: str = "restored",
    json: bool = False,
) -> DataFrame:
    """Replace every token that verifies and is in the vault of its own scope.

    Rows meet their values by a digest of scope and text, so keys may repeat or
    be null; ``key`` only spreads rows without a token. The text is shuffled once.
    The vault join is on distinct (scope, token): a token in half of all rows is
    looked up once, and giving it back is a join with one row per token, which
    Spark splits. Restored text is put together in one pass and never searched
    again. With ``json``, texts that are JSON get values as inside a JSON string.
    """
    eligible = has_token(F.col(text)) & F.col(scope).isNotNull()
    found = (
        df.filter(eligible)
        .select(
            _contents(text, scope).alias("_contents"),
            F.col(scope).cast("string").alias("scope_id"),
            F.explode(
                F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TOKEN_PATTERN), F.lit(0)))
            ).alias("token"),
        )
        .distinct()
    )
    values = verify_and_lookup(found.select("scope_id", "token").distinct(), vault, keys)
    per_text = (
        found.join(values, ["scope_id", "token"])
        .groupBy("_contents")
        .agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))
    )
    spread = F.concat(F.lit("-"), F.xxhash64(F.col(text), *[F.col(k) for k in key]).cast("string"))
    named = df.withColumn("_contents", F.when(eligible, _contents(text, scope)).otherwise(spread))
    return (
        named.join(per_text, "_contents", "left")
        .withColumn("_values", _fitting(F.col(text), F.col("_values")) if json else F.col("_values"))
        .withColumn(out, substitute(F.col(text), F.col("_values")))
        .drop("_contents", "_values")
    )


def _fitting(text: Column, values: Column) -> Column:
    """Values encoded for a text that is JSON."""
    encoded = F.transform_values(values, lambda _, v: json_string(v))
    return F.when(values.isNotNull() & parsed_body(text).isNotNull(), encoded).otherwise(values)


def substitute(text: Column, values: Column) -> Column:
    """Swap tokens for the values of a token-to-value map, in one pass."""
    hits = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    gaps = F.split(text, TOKEN_PATTERN, -1)
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    whole = F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(
                p["gap"], F.coalesce(F.try_element_at(values, p["hit"]), p["hit"], F.lit(""))
            ),
        ),
        "",
    )
    return F.when(values.isNull(), text).otherwise(whole)


def redact_between_tokens(
    df: DataFrame, text: str, scope: str, cfg: ScanConfig, out: str, spans: str
) -> DataFrame:
    """``redact`` for text that already holds tokens; needs key columns.

    Only the text between tokens is searched: a token next to, say, ``api_key=``
    is not mistaken for a new key.
    """
    # step by step: in one expression the lambdas nest deeper than Spark resolves
    found = df.withColumn("_hits", find_all(F.col(text), TOKEN_PATTERN))
    ends = F.transform("_hits", lambda h: h["start"] + F.length(h["value"]))
    cut = found.withColumn(
        "_gaps",
        F.arrays_zip(
            F.split(text, TOKEN_PATTERN, -1).alias("gap"),
            F.concat(F.array(F.lit(0)), ends).alias("at"),
            F.col("_hits")["value"].alias("token"),
        ),
    )
    done = cut.withColumn(
        "_parts",
        F.transform(
            "_gaps",
            lambda p: F.struct(
                p["at"].alias("at"), p["token"].alias("token"),
                redact_column(p["gap"], F.col(scope), cfg).alias("r"),
            ),
        ),
    )
    joined = F.transform(
        "_parts", lambda p: F.concat(p["r"]["redacted"], F.coalesce(p["token"], F.lit("")))
    )
    lost = F.exists("_parts", lambda p: p["r"]["redacted"].isNull())
    shifted = F.flatten(F.transform("_parts", lambda p: shift(p["r"]["spans"], p["at"])))
    return (
        done.withColumn(out, F.when(~lost, F.array_join(joined, "")))
        .withColumn(spans, F.coalesce(shifted, empty(REDACTED_SPANS_TYPE)))
        .drop("_hits", "_gaps", "_parts")
    )


def _stored(hidden: DataFrame, key: Sequence[str], scope: str, text: str, spans: str) -> DataFrame:
    """Key, scope, hidden text and spans without values, written once.

    Restoring reads its input twice; no raw value is stored.
    """
    kept = F.transform(spans, lambda s: s.dropFields("value")).alias("response_spans")
    names = dict.fromkeys([*key, scope])
    return materialise(hidden.select(*names, F.col(text).alias("_hidden"), kept), "screened")


def screen_response(
    df: DataFrame,
    text: str,
    scope: str,
    key: Sequence[str],
    cfg: ScanConfig,
    vault: DataFrame,
    keys: Keyring,
    out: str = "response",
) -> DataFrame:
    """Hide values that are new in a response, then restore the request's own.

    Tokens made for the response are not in the request-side vault, so what the
    scan has just hidden stays hidden. Gives key, scope, ``response`` and
    ``response_spans`` (without values).
    """
    hidden = without_keys(
        redact_between_tokens(with_keys(df, keys), text, scope, cfg, "_hidden", "_spans")
    )
    stored = _stored(hidden, key, scope, "_hidden", "_spans")
    return rehydrate(stored, "_hidden", scope, key, vault, keys, out=out).drop("_hidden")


def screen_bodies(
    df: DataFrame,
    key: Sequence[str],
    cfg: ScanConfig,
    vault: DataFrame,
    keys: Keyring,
    scope: str = "request_id",
    body: str = "body",
    provider: str = "provider",
    only: tuple[str, ...] = (),
    formats: Formats = FORMATS,
    out: str = "response",
) -> DataFrame:
    """``screen_response`` for response bodies: texts are found, scanned and put back
    by their format; tokens of the request's own vault are restored."""
    hidden = redact_bodies(df, cfg, keys, scope, body, provider, "response", only, formats)
    stored = _stored(hidden, key, scope, "redacted_body", "spans")
    return rehydrate(stored, "_hidden", scope, key, vault, keys, out=out, json=True).drop("_hidden")


def expire_scopes(vault: DataFrame, expired: DataFrame) -> DataFrame:
    """The vault without the scopes listed in ``expired`` (column ``scope_id``)."""
    return vault.join(expired.select("scope_id").distinct(), "scope_id", "left_anti")
