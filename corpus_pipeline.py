"""A training corpus in five stages, from the table of documents.

Language ID, near duplicates, decontamination, mixing, sharding: each takes the
documents that the one before it kept and calls one operator. Between stages
documents are written as Parquet to the shared folder, so a lost executor costs a
re-read. Columns of the documents pass through under neutral names, so further
ones cannot clash with what an operator adds.

Defined results: documents whose text is null or has no letter go in the first
stage; rows equal in id and text count as one document from the second on; null
ids are told apart by their text; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontaminate, jaccard_join, langid, mixing, sharding
from veilframe.llm.oracles import PIPELINE
from veilframe.llm.queries import fold
from veilframe.sources.workdir import materialise

USED = ("doc_id", "text", "lang", "source")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _neutral(docs: DataFrame) -> DataFrame:
    """Columns that no stage uses get names that no operator gives."""
    return docs.toDF(*[c if c in USED else f"__column{i}" for i, c in enumerate(docs.columns)])


def _restored(rows: DataFrame, docs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    plain = _neutral(docs).columns
    own = [F.col(a).alias(b) for a, b in zip(plain, docs.columns, strict=True) if b not in extra]
    return rows.select(*own, *extra)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _id_key() -> Column:
    """The id as text, never null."""
    return F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the model learns from their own labels.

    Only ``und`` goes: the texts without a letter, if any label can be learnt.
    """
    plain = _neutral(docs)
    model = langid.train(plain, fold(F.col("doc_id"), 3) != 1)
    told = langid.identify(plain, model, keep=plain.columns, names=("__lang", "__score", "__unsure"))
    return _restored(told.filter(F.col("__lang") != langid.UNKNOWN), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    plain = _neutral(docs).withColumn("__th", _text_hash()).withColumn("__id", _id_key())
    marks = jaccard_join.near_components(plain).withColumn("__id", _id_key())
    alone = F.concat_ws("|", "__id", "th")  # an empty set is a group of its own
    # the smallest id that is not null, if there is one
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("th"), F.col("__id"))
    stays = materialise(
        marks.groupBy(F.coalesce("component", alone).alias("group"))
        .agg(F.min(rank).alias("first"))
        .select(F.col("first.th").alias("__th"), F.col("first.__id").alias("__id")),
        "stays",
    )
    names = _neutral(docs).columns
    row = F.struct(*names)
    one = (
        plain.join(stays, ["__th", "__id"])
        .groupBy("__th", "__id")
        .agg(F.min_by(row, F.xxhash64(*names)).alias("row"))
        .select("row.*")
    )
    return _restored(one, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no, or too little, benchmark text."""
    plain = _neutral(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate.judge(decontaminate.search(plain, items))
    goes = materialise(
        judged.filter("contaminated")
        .select(F.col("th").alias("__th"), F.col("id").alias("doc_id"))
        .select("__th", _id_key().alias("__id"))
        .distinct(),
        "contaminated",
    )
    kept = (
        plain.withColumn("__th", _text_hash()).withColumn("__id", _id_key())
        .join(goes, ["__th", "__id"], "left_anti")
    )
    return _restored(kept, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them, in training order.

    Documents stay whole: a use of less than half of one is left out.
    """
    used = mixing.training_order(mixing.mix(_neutral(docs)))
    return _restored(used.filter(F.col("words") * 2 >= F.col("size")), docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, its slot there, and its shard after growth."""
    extra = ("law", "shard", "slot", "grown_shard")
    return _restored(sharding.shard(_neutral(docs)), docs, extra)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

ORACLE_SQL: str | None = PIPELINE


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
