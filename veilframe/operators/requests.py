"""Request metadata: headers, query strings, ids and callers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import SCAN_HEADERS, ScanConfig
from veilframe.functions.crypto import Keyring, with_keys, without_keys
from veilframe.functions.spans import let
from veilframe.operators.detect import explode_spans, scan_column
from veilframe.operators.redact import redact_column


def redact_headers(
    df: DataFrame,
    cfg: ScanConfig,
    keys: Keyring,
    scope: str = "request_id",
    headers: str = "headers",
    names: Iterable[str] = SCAN_HEADERS,
    out: str = "redacted_headers",
) -> DataFrame:
    """Redact the values of the listed headers (names compare ignoring case)."""
    listed = [n.lower() for n in names]
    done = with_keys(df, keys).withColumn(
        out,
        F.transform_values(
            headers,
            lambda k, v: F.when(
                F.lower(k).isin(*listed), redact_column(v, F.col(scope), cfg)["redacted"]
            ).otherwise(v),
        ),
    )
    return without_keys(done)


def header_spans(
    df: DataFrame, cfg: ScanConfig, *keys: str, headers: str = "headers",
    names: Iterable[str] = SCAN_HEADERS,
) -> DataFrame:
    """One row per span in a listed header."""
    listed = [n.lower() for n in names]
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]).isin(*listed))
    rows = df.select(*keys, F.explode_outer(entries).alias("_h")).filter(F.col("_h").isNotNull())
    rows = rows.select(
        *keys, F.col("_h.key").alias("header"), scan_column(F.col("_h.value"), cfg).alias("spans")
    )
    return explode_spans(rows, *keys, "header")


def query_pairs(url: Column) -> Column:
    """``array<struct<key,value,raw>>`` in order.

    ``raw`` is set, to the whole pair, where key or value can't be decoded (or
    where a semicolon leaves open what is meant); key and value are then NULL.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)

    def pair(p: Column) -> Column:
        key = F.try_url_decode(F.regexp_extract(p, "(?s)^([^=]*)", 1))
        value = F.try_url_decode(F.regexp_extract(p, "(?s)^[^=]*=?(.*)$", 1))
        sound = key.isNotNull() & value.isNotNull() & ~F.contains(p, F.lit(";"))
        return F.struct(
            F.when(sound, key).alias("key"),
            F.when(sound, value).alias("value"),
            F.when(~sound, p).alias("raw"),
        )

    return F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)


def encode_query(text: Column) -> Column:
    """Form encoding: everything but letters, digits and ``-_.~``; space as plus."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def rewrite_query(url: Column, change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to every query value, and to pairs that can't be decoded as a whole.

    The URL is rebuilt, sorted by key with undecodable pairs last, only when
    something did change.
    """
    def build(pairs: Column) -> Column:
        changed = F.transform(
            pairs,
            lambda p, i: F.struct(
                p["key"].isNull().alias("last"), p["key"].alias("key"), i.alias("i"),
                F.coalesce(p["value"], p["raw"]).alias("old"),
                change(F.coalesce(p["value"], p["raw"])).alias("new"),
            ),
        )
        return let(changed, join)

    def join(rows: Column) -> Column:
        query = F.array_join(
            F.transform(
                F.array_sort(rows),
                lambda r: F.when(r["last"], r["new"]).otherwise(
                    F.concat(encode_query(r["key"]), F.lit("="), encode_query(r["new"]))
                ),
            ),
            "&",
        )
        head = F.regexp_extract(url, r"^([^?#]*)", 1)
        tail = F.regexp_extract(url, r"(?s)^[^#]*(#.*)?$", 1)
        touched = F.exists(rows, lambda r: r["old"] != r["new"])
        return F.when(touched, F.concat(head, F.lit("?"), query, tail)).otherwise(url)

    return let(query_pairs(url), build)


def redact_query(
    df: DataFrame, url: str, scope: str, cfg: ScanConfig, keys: Keyring, out: str = "redacted_url"
) -> DataFrame:
    """Redact values in the query string of a URL."""
    done = with_keys(df, keys).withColumn(
        out,
        rewrite_query(
            F.col(url), lambda v: redact_column(v, F.col(scope), cfg)["redacted"]
        ),
    )
    return without_keys(done)


def correlation_id(request_id: Column, *row_key: Column) -> Column:
    """The given id, else a UUID-shaped hash of the row key.

    A hash rather than ``uuid()``: a retried task must produce the same id.
    """
    h = F.sha2(F.concat_ws("\u001f", *[k.cast("string") for k in row_key]), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])
    return F.coalesce(F.nullif(request_id, F.lit("")), made)


def caller(user_id: Column) -> Column:
    """The caller's identity for the audit table, empty when unknown."""
    return F.coalesce(user_id.cast("string"), F.lit(""))
