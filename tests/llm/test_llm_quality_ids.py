"""Quality scores with ids that are not integers."""

from pyspark.sql import functions as F

from veilframe.llm import quality


def test_string_ids(spark, make):
    docs = make([(i, ("good plain words " if i % 2 else "BUY now $$$ click ") * 5) for i in range(60)])
    docs = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    labels = docs.select("doc_id", F.regexp_extract("doc_id", r"(\d+)", 1).cast("int").alias("n"))
    labels = labels.select("doc_id", (F.col("n") % 2).alias("quality"))
    vectors = quality.word_vectors(docs)
    net = quality.train(docs, labels, F.lit(True), vectors)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, vectors, net).collect()}
    assert len(rows) == 60 and all(0 <= s <= 1 for s in rows.values())
    assert min(rows[f"d{i}"] for i in range(1, 60, 2)) > max(rows[f"d{i}"] for i in range(0, 60, 2))
