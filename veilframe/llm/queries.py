"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import (
    conv_repair,
    decontaminate,
    exact_dedup,
    jaccard_join,
    langid,
    licenses,
    mixing,
    pii_bootstrap,
    prefix_trie,
    quality,
    sharding,
    suffix_dedup,
    token_ids,
)
from veilframe.sources.workdir import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return (
        mixed.select("doc_id", "size", "source_size", "target", "taken", "position")
        .repartitionByRange("position", "doc_id")
        .sortWithinPartitions("position", "doc_id")
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels, ~held_out, vectors)
    return quality.score(docs, vectors, net).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[
            pii_bootstrap.count_kind("base", i).alias(f"n_{kind}")
            for i, kind in enumerate(pii_bootstrap.KINDS)
        ],
        F.sha2(pii_bootstrap.spans_text("base").cast("binary"), 256).alias("base_sha256"),
        pii_bootstrap.spans_text("spans").alias("spans"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start_word", "end_word", "n_words")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    judged = decontaminate.judge(decontaminate.search(docs, items))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
        "n_near",
        F.sha2(F.array_join("near", ",").cast("binary"), 256).alias("near_sha256"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 3) == 1
    found = langid.identify(docs, langid.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "start", "end", "license", "size", "saved",
        (F.col("license").isNotNull() & (F.col("missing") == "") & (F.col("extra") == "")).alias("exact"),
        "missing", "extra",
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.borrow_heads(turns))


def op12_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = shared_dir(spark, "corpus-ids")
    token_ids.write_ids(docs, path)
    return token_ids.read_documents(spark, path, docs.schema["doc_id"].dataType).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conv_repair.repair_all(conv_repair.damage(rows), rows)


def all_queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_sharding": op2_sharding,
        "op3_quality": op3_quality,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_pii": op5_pii,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_language_id": op8_language_id,
        "op9_licenses": op9_licenses,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_ids": op12_token_ids,
        "op13_conversation_repair": op13_conversation_repair,
    }
