"""Held-out accuracy and odd rows of the trained models."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilframe.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_codebooks_tell_classes_apart():
    assert langid.codebook(4).shape == (4, 7)
    for n in (2, 3, 7, 12, 40):
        code = langid.codebook(n).astype(int)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n < 3 else 2)
        assert (np.abs(code.sum(axis=0)) < n).all()


def test_language_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language_id(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(make, odd):
    rng = random.Random(1)
    lines = {"aa": "kata mita", "bb": "vöß züd", "cc": "qwrt plst"}
    rows = [
        (i + 50, " ".join(rng.choice(lines[g].split()) for _ in range(20)), g)
        for i, g in enumerate(sorted(lines) * 30)
    ]
    model = langid.train(make(rows), F.lit(True))
    assert model.languages == ("aa", "bb", "cc")
    got = langid.identify(make([*odd, (60, "kata mita kata", None)]), model).collect()
    assert len(got) == len(odd) + 1
    for r in got:
        if r["doc_id"] in (3, 4, 5, 6):
            assert (r["lang_pred"], r["score"], r["ambiguous"]) == ("und", 0.0, True)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 60] == ["aa"]
    kept = langid.identify(make(odd), model, keep=["id", "size", "doc_id"]).columns
    assert kept == ["id", "size", "doc_id", "lang_pred", "score", "ambiguous"]


@pytest.mark.parametrize("langs", [[], ["xx"]])
def test_none_or_one_language(make, odd, langs):
    model = langid.train(make([(1, "some words", g) for g in langs]), F.lit(True))
    got = {r["lang_pred"] for r in langid.identify(make(odd), model).collect()}
    assert got == ({"und"} | set(langs))
    assert langid.identify(make([]), model).count() == 0


def test_long_texts_count_as_a_whole():
    text = b"ab cd ef " * 400_000
    assert langid.gram_counts(text).sum() == 3 * len(text) - 3


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op3_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95
    good = [r["score"] for r in got if r["quality"]]
    bad = [r["score"] for r in got if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_of_odd_rows(spark, make, odd):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (7, 0, 0), (7, None, 0), (None, 1, 0), (99, 1, 0), (8, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    vectors = quality.word_vectors(make(odd))
    net = quality.train(make(odd), labels, F.lit(True), vectors)
    got = quality.score(make(odd), vectors, net).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5)}) == 1
    flat = quality.train(make(odd), labels.limit(0), F.lit(True), vectors)
    assert {r["score"] for r in quality.score(make(odd), vectors, flat).collect()} == {0.5}
    assert quality.word_vectors(make([])).any() == np.False_
    assert quality.score(make([]), vectors, net).count() == 0


def test_context_sums_do_not_depend_on_the_split():
    texts = pa.array(["one two three two one", None, "three one", ""])
    at, sign = quality.index_vectors()
    whole, parts = (np.zeros(quality.BUCKETS * quality.DIM) for _ in range(2))
    quality.context_sums(quality.tokens(texts), whole, at, sign)
    for i in range(len(texts)):
        quality.context_sums(quality.tokens(texts[i : i + 1]), parts, at, sign)
    assert (whole == parts).all() and whole.any()


def test_pooling_of_a_long_text_equals_plain_means():
    texts = pa.array([" ".join(f"w{i % 50}" for i in range(200_000)), "w1 w1"])
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    found = quality.tokens(texts)
    rows = vectors[quality._rows(found.of(0))]
    got = quality.pool(texts, vectors)
    assert np.allclose(got[0, : quality.DIM], rows.mean(axis=0), atol=1e-3)
    assert np.allclose(got[0, quality.DIM : 2 * quality.DIM], rows.std(axis=0), atol=1e-2)
    assert got[1, 2 * quality.DIM] == 0.5
