"""The end of scopes as a stored effect: values go from the vault, and from its copies.

A scope key is derived from the keyring and a random salt that is stored once per
scope. Values sealed under it can be read as long as the salt is there: dropping
the salt erases them in every copy of the vault, backups too. The stored vault is
rewritten day by day, and only the days that hold an ended scope.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.crypto import Keyring, decrypt, encrypt, framed, hmac_sha256, with_keys, without_keys
from veilframe.operators.redact import vault_values
from veilframe.sources.workdir import materialise


def new_scope_keys(scopes: DataFrame, scope: str = "scope_id") -> DataFrame:
    """``scope_id, salt``: one random salt for each scope; null scopes get none.

    Store the table before using it: every evaluation draws new salts.
    """
    named = scopes.select(F.col(scope).cast("string").alias("scope_id")).filter("scope_id is not null")
    return named.distinct().withColumn("salt", F.sha2(F.concat(F.uuid(), F.uuid()).cast("binary"), 256))


def drop_scope_keys(scope_keys: DataFrame, expired: DataFrame) -> DataFrame:
    """The salts without those of ended scopes."""
    return scope_keys.join(expired.select("scope_id").distinct(), "scope_id", "left_anti")


def _under_scope_keys(df: DataFrame, scope_keys: DataFrame, keys: Keyring) -> DataFrame:
    """``with_keys``, the encryption key replaced by the scope's, NULL where it has no salt."""
    salts = scope_keys.groupBy("scope_id").agg(F.min("salt").alias("_salt"))
    keyed = with_keys(df.join(salts, "scope_id", "left"), keys)
    message = framed(F.lit("scope key"), F.hex("_enc_key"), F.col("scope_id"), F.col("_salt"))
    return keyed.withColumn("_enc_key", F.unhex(hmac_sha256(message))).drop("_salt")


def build_scoped_vault(
    redacted: DataFrame, scope: str, scope_keys: DataFrame, keys: Keyring, spans: str = "spans"
) -> DataFrame:
    """``build_vault`` under scope keys. A scope without a salt keeps no ciphertext."""
    values = _under_scope_keys(vault_values(redacted, scope, spans), scope_keys, keys)
    sealed = encrypt(F.col("value"), F.col("scope_id"), F.col("token"))
    return without_keys(values.withColumn("ciphertext", sealed).drop("value"))


def lookup(tokens: DataFrame, vault: DataFrame, scope_keys: DataFrame, keys: Keyring) -> DataFrame:
    """Adds ``value``: NULL for tokens the vault does not hold and for scopes without a salt."""
    held = vault.groupBy("scope_id", "token").agg(F.min("ciphertext").alias("ciphertext"))
    joined = _under_scope_keys(tokens.join(held, ["scope_id", "token"], "left"), scope_keys, keys)
    value = decrypt(F.col("ciphertext"), F.col("scope_id"), F.col("token"))
    return without_keys(joined.withColumn("value", value).drop("ciphertext"))


def _folder(spark: SparkSession, name: str):
    """A folder told by a file's address, as a path of its file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def expire_stored(spark: SparkSession, path: str, expired: DataFrame, day: str = "scope_date") -> int:
    """Remove ended scopes from a vault stored by day; returns how many days were rewritten.

    Days without an ended scope are not touched. The rows that stay are written
    aside first and replace their days in one commit; a day of which nothing stays is
    removed. Broken off at any point, the call can be repeated. Names of days with an
    ended scope, and nothing else, come to the driver.
    """
    ended = expired.select("scope_id").distinct()
    of_file = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    hit = (
        spark.read.parquet(path).select("scope_id", of_file.alias("_folder"))
        .join(ended, "scope_id", "left_semi").select("_folder").distinct()
    )
    folders = {r["_folder"] for r in hit.collect()}
    if not folders:
        return 0
    schema = spark.read.parquet(path).schema
    days = spark.read.schema(schema).option("basePath", path).parquet(
        *[_folder(spark, f)[0].toString() for f in sorted(folders)]
    )
    kept = days.withColumn("_folder", of_file).join(ended, "scope_id", "left_anti")
    aside = materialise(kept.select(*schema.names, "_folder"), "vault-days")
    (
        aside.drop("_folder").hint("rebalance", day)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )
    for name in folders - {r["_folder"] for r in aside.select("_folder").distinct().collect()}:
        emptied, files = _folder(spark, name)
        files.delete(emptied, True)
    return len(folders)
