"""Redaction: spans to signed tokens, and the vault that can undo it."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.crypto import Keyring, encrypt, with_keys, without_keys
from veilframe.functions.spans import by_start, empty, let, shift, splice
from veilframe.functions.tokens import mint_token
from veilframe.operators.detect import analysed_units, explode_spans, glue_of, scan

REDACTED_SPANS_TYPE = (
    "array<struct<type:string,start:int,end:int,value:string,"
    "confidence:double,detector_name:string,token:string>>"
)


def tokenised(spans: Column, scope: Column) -> Column:
    """Add each span's token; needs key columns."""
    return F.transform(
        spans, lambda s: s.withField("token", mint_token(scope, s["type"], s["value"]))
    )


def split_scoped(df: DataFrame, scope: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a scope, and the rejected rest with a reason.

    Without a scope no token can be made; such texts come back NULL from
    ``redact`` if they hold anything to hide.
    """
    lost = df.filter(F.col(scope).isNull()).withColumn("reason", F.lit("no scope"))
    return df.filter(F.col(scope).isNotNull()), lost


def _one_piece(text: Column, spans: Column, scope: Column) -> Column:
    """``struct<redacted,spans>`` of one piece of text; NULL if a token is missing."""
    return let(
        tokenised(spans, scope),
        lambda t: F.struct(
            F.when(scope.isNotNull() | (F.size(t) == 0), splice(text, t, lambda s: s["token"]))
            .alias("redacted"),
            t.alias("spans"),
        ),
    )


def redact_column(text: Column, scope: Column, cfg: ScanConfig) -> Column:
    """``struct<redacted,spans>`` as one expression; needs key columns.

    Text without spans comes back untouched, null stays null. Text with spans
    but without a scope becomes NULL: it fails closed.
    """
    pieces = F.transform(
        analysed_units(text, cfg),
        lambda u: F.struct(
            u["start"].alias("start"), _one_piece(u["text"], u["spans"], scope).alias("r")
        ),
    )
    return let(
        pieces,
        lambda p: F.struct(
            F.when(
                text.isNull() | F.exists(p, lambda u: u["r"]["redacted"].isNull()),
                F.lit(None).cast("string"),
            )
            .otherwise(F.array_join(F.transform(p, lambda u: u["r"]["redacted"]), ""))
            .alias("redacted"),
            F.coalesce(
                F.flatten(F.transform(p, lambda u: shift(u["r"]["spans"], u["start"]))),
                empty(REDACTED_SPANS_TYPE),
            ).alias("spans"),
        ),
    )


@lru_cache(maxsize=64)
def _redact_expression(text: str, scope: str, cfg: ScanConfig, gateway: int) -> Column:
    return redact_column(F.col(text), F.col(scope), cfg)


def redact(
    df: DataFrame,
    text: str,
    scope: str,
    cfg: ScanConfig,
    keys: Keyring,
    out: str = "redacted",
    spans: str = "spans",
) -> DataFrame:
    """Add the redacted text and its spans with tokens. Narrow: no shuffle."""
    if any(d.on_rows for d in cfg.detectors) or glue_of(cfg) is None:
        return replace_spans(scan(df, text, cfg, out=spans), text, spans, scope, keys, out)
    keyed = with_keys(df, keys)
    done = keyed.withColumn("_r", _redact_expression(text, scope, cfg, id(SparkContext._gateway)))
    return without_keys(
        done.withColumn(out, F.col("_r.redacted")).withColumn(spans, F.col("_r.spans")).drop("_r")
    )


def replace_spans(
    df: DataFrame, text: str, spans: str, scope: str, keys: Keyring, out: str = "redacted"
) -> DataFrame:
    """Redact spans found elsewhere (disjoint, any order)."""
    done = with_keys(df, keys).withColumn(
        "_r", _one_piece(F.col(text), by_start(F.col(spans)), F.col(scope))
    )
    return without_keys(
        done.withColumn(out, F.col("_r.redacted")).withColumn(spans, F.col("_r.spans")).drop("_r")
    )


def vault_values(redacted: DataFrame, scope: str, spans: str = "spans") -> DataFrame:
    """``scope_id, token, pii_type, value``: one row per value and scope.

    Equal values collapse before the shuffle (partial distinct), so a value
    repeated through a hot scope costs one row per task.
    """
    found = explode_spans(
        redacted.select(F.col(scope).cast("string").alias("scope_id"), F.col(spans).alias("s")),
        "scope_id",
        spans="s",
    )
    return found.filter(F.col("token").isNotNull()).select(
        "scope_id", "token", F.col("type").alias("pii_type"), "value"
    ).distinct()


def build_vault(redacted: DataFrame, scope: str, keys: Keyring, spans: str = "spans") -> DataFrame:
    """``scope_id, token, pii_type, ciphertext``: ``vault_values``, encrypted."""
    values = vault_values(redacted, scope, spans)
    sealed = encrypt(F.col("value"), F.col("scope_id"), F.col("token"))
    return without_keys(
        with_keys(values, keys).withColumn("ciphertext", sealed).drop("value")
    )


def token_counts(vault: DataFrame) -> DataFrame:
    """Number of distinct values held per scope."""
    return vault.groupBy("scope_id").agg(F.countDistinct("token").alias("tokens"))


def leaked(redacted: Column, spans: Column) -> Column:
    """True when any detected value still occurs in the redacted text."""
    return F.exists(spans, lambda s: F.contains(redacted, s["value"]))
