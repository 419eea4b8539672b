"""Uploaded files: decide whether bytes are text, and scan them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.config import ScanConfig
from veilframe.functions.spans import let
from veilframe.operators.detect import scan

# --- fixed values: text suffixes and sniffing limits --------------------------
TEXT_SUFFIXES = (
    ".txt", ".csv", ".json", ".xml", ".md", ".yaml", ".yml", ".log",
    ".tsv", ".html", ".htm", ".sql", ".env", ".conf", ".ini",
)
BASE64_MIN_BYTES = 20
PRINTABLE_SHARE = 0.85
# --- end of fixed values ------------------------------------------------------


def as_text(content: Column) -> Column:
    """Bytes as UTF-8 text; invalid sequences become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def likely_base64(content: Column) -> Column:
    """At least 20 bytes, all of them of the base64 alphabet or line breaks."""
    plain = F.decode(content, "ISO-8859-1")
    return (F.octet_length(content) >= BASE64_MIN_BYTES) & plain.rlike(r"\A[A-Za-z0-9+/=\n\r]*\z")


def decode_base64(content: Column) -> Column:
    """Decoded bytes; line breaks are ignored, anything malformed gives NULL."""
    packed = F.regexp_replace(F.decode(content, "ISO-8859-1"), r"[\r\n]", "")
    whole = packed.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(packed) % 4 == 0)
    return F.when(whole, F.unbase64(packed))


def likely_text(content: Column) -> Column:
    """More than 85 % of the bytes printable; empty is not text."""
    plain = F.decode(content, "ISO-8859-1")
    printable = F.length(F.regexp_replace(plain, r"[^\x20-\x7E\n\r\t]+", ""))
    return F.coalesce(
        (F.length(plain) > 0) & (printable / F.length(plain) > F.lit(PRINTABLE_SHARE)),
        F.lit(False),
    )


def _has_text_suffix(path: Column) -> Column:
    suffixes = "|".join(s[1:] for s in TEXT_SUFFIXES)
    return F.lower(path).rlike(rf"\.({suffixes})\z")


def file_text(path: Column, content: Column) -> Column:
    """Scannable text of a file: by suffix, else decoded base64, else NULL."""
    decoded = let(decode_base64(content), lambda d: F.when(likely_text(d), as_text(d)))
    return F.when(_has_text_suffix(path), as_text(content)).when(likely_base64(content), decoded)


def skipped_reason(path: Column, content: Column) -> Column:
    """Why a file has no text; NULL for one that has. Nothing unread counts as clean."""
    inside = F.when(decode_base64(content).isNull(), "malformed base64").when(
        ~likely_text(decode_base64(content)), "not text inside base64"
    )
    return (
        F.when(content.isNull(), "no content")
        .when(_has_text_suffix(path), F.lit(None).cast("string"))
        .when(likely_base64(content), inside)
        .otherwise("not text")
    )


def scan_files(
    df: DataFrame, cfg: ScanConfig, path: str = "path", content: str = "content"
) -> DataFrame:
    """Add the extracted ``text``, its ``spans`` and ``skipped_reason``; the bytes go."""
    why = skipped_reason(F.col(path), F.col(content))
    rows = df.withColumn("skipped_reason", why)
    rows = rows.withColumn("text", file_text(F.col(path), F.col(content))).drop(content)
    return scan(rows, "text", cfg)


def upload_totals(files: DataFrame, upload: str = "request_id") -> DataFrame:
    """Detections per upload."""
    return files.groupBy(upload).agg(
        F.coalesce(F.sum(F.size("spans")), F.lit(0)).cast("int").alias("pii_count")
    )
