"""Keyed hashes and authenticated encryption built from Spark functions.

Keys travel as columns of a one-row broadcast frame, never as literals, so they
show up neither in column names nor in ``explain``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCK = 64
_KEY_COLUMNS = ("_mac_in", "_mac_out", "_enc_key")
_KEY_ID = "_key_id"


@dataclass(frozen=True, repr=False)
class Keyring:
    """The signing key (up to 64 bytes) and the encryption key (16, 24 or 32)."""

    mac_key: bytes
    enc_key: bytes

    def __post_init__(self) -> None:
        if not 16 <= len(self.mac_key) <= _BLOCK:
            raise ValueError("mac_key must have 16 to 64 bytes")
        if len(self.enc_key) not in (16, 24, 32):
            raise ValueError("enc_key must have 16, 24 or 32 bytes")

    def frame(self, spark: SparkSession) -> DataFrame:
        padded = self.mac_key.ljust(_BLOCK, b"\0")
        row = (
            0,
            bytes(b ^ 0x36 for b in padded),
            bytes(b ^ 0x5C for b in padded),
            self.enc_key,
        )
        schema = T.StructType(
            [T.StructField(_KEY_ID, T.IntegerType(), False)]
            + [T.StructField(c, T.BinaryType(), False) for c in _KEY_COLUMNS]
        )
        return spark.createDataFrame([row], schema)


def with_keys(df: DataFrame, keys: Keyring) -> DataFrame:
    """Put the key columns next to every row (broadcast of exactly one row)."""
    frame = F.broadcast(keys.frame(df.sparkSession))
    return df.withColumn(_KEY_ID, F.lit(0)).join(frame, _KEY_ID)


def without_keys(df: DataFrame) -> DataFrame:
    return df.drop(_KEY_ID, *_KEY_COLUMNS)


def hmac_sha256(message: Column) -> Column:
    """HMAC-SHA256 of a string as lower-case hex; needs ``with_keys``."""
    inner = F.sha2(F.concat(F.col("_mac_in"), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.col("_mac_out"), F.unhex(inner)), 256)


def framed(*parts: Column) -> Column:
    """Parts with their lengths in front: different parts never frame alike."""
    return F.concat(
        *[F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    )


def encrypt(value: Column, *context: Column) -> Column:
    """AES-GCM with the nonce in front, bound to its context; needs ``with_keys``.

    The nonce is a keyed hash of context and value, so a retried task writes the
    same bytes and two different values never share one. Only the same context
    decrypts.
    """
    message = F.concat(F.lit("nonce:"), framed(*context, value))
    nonce = F.substring(F.unhex(hmac_sha256(message)), 1, 12)
    return F.aes_encrypt(
        value, F.col("_enc_key"), F.lit("GCM"), F.lit("DEFAULT"), nonce, framed(*context)
    )


def decrypt(ciphertext: Column, *context: Column) -> Column:
    """The plain text, or NULL when the bytes are short, altered or of another context."""
    return F.try_aes_decrypt(
        ciphertext, F.col("_enc_key"), F.lit("GCM"), F.lit("DEFAULT"), framed(*context)
    ).cast("string")
