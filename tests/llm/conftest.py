import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)
VERY_LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
PROSE = " ".join(f"alpha{i} beta{i * 7 % 31} gamma" for i in range(40))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) or shorter rows."""

    def build(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)), 7, "own", "own", "own") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls everywhere, empty and very long texts, ties and repeated rows."""
    return [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, " \t\n ", "de", "b"),
        (6, "12 34 !?", "de", "b"),
        (None, PROSE + " tail", "en", "b"),
        (None, None, None, None),
        (None, None, None, None),
        (7, VERY_LONG, "de", "a"),
        (8, "x" * 300_000, "de", "c"),
        (9, "Ünïcode ÉÉ wörds ß", "de", ""),
    ]
