"""Exact deduplication in three combines, each on whole texts.

1. Within each input partition equal texts become one row (the partial
   aggregation before the shuffle).
2. Rows meet by digest, text and a salt, so that a group of copies with a third
   of all rows is split over ``salts`` tasks.
3. The salts' winners meet by digest and text.

The text is part of every grouping key, so two texts with one digest never
merge. The outcome goes back to the rows by digest alone, narrow rows without
text; only if a digest holds several texts are its rows matched by text too.

Defined results: null text counts as empty; of rows equal in text *and* id
exactly one is kept; a null id loses to any other; an empty table gives an empty
table; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.sources.workdir import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(rows: DataFrame, salts: int) -> DataFrame:
    """One row per distinct text: digest, text, largest id, rows.

    ``rows`` has ``id``, ``digest`` and ``norm``.
    """
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    salted = rows.groupBy("digest", "norm", salt.alias("salt")).agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return salted.groupBy("digest", "norm").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of each group of equal texts stays.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")
    ).withColumn("digest", digest(F.col("norm")))
    found = materialise(
        groups(rows, salts).select(
            "digest", "keep_id", "group_size", sha256(F.col("norm")).alias("text_sha256")
        ),
        "copies",
    )
    per_digest = found.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    shared = per_digest.filter("texts > 1").select("digest")
    if shared.isEmpty():
        members = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("times"))
        matched = members.join(found, "digest")
    else:  # only here do texts have to tell groups apart
        members = rows.groupBy("digest", "norm", "id").agg(F.count(F.lit(1)).alias("times"))
        matched = members.join(
            groups(rows, salts).withColumn("text_sha256", sha256(F.col("norm"))), ["digest", "norm"]
        )
    return (
        matched.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(
            F.col("id").alias(id_col),
            "keep_id",
            F.col("group_size").cast("long").alias("group_size"),
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
            "text_sha256",
        )
    )
