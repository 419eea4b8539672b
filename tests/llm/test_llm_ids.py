"""Token ids in files: Elias-Fano codes, encoding of whole texts, and the way back."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import token_ids
from veilframe.sources.workdir import shared_dir


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_ids.vocabulary_file())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, token_ids.END_ID]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900), st.integers(0, 3))
def test_elias_fano(steps, shift):
    values = np.cumsum(np.array(steps, dtype=np.int64) << (8 * shift))
    code = token_ids.EliasFano.of(values)
    assert code.all().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.full(100_000, 250))
    size = sum(map(len, token_ids.EliasFano.of(values).parts()))
    assert size * 8 < 100_000 * 10.2  # 7 low bits, at most 3 in the vector, samples


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1.,'s\t\n\r\x0b\x1c\x85\xa0 　é漢😀<|>"), max_size=60), max_size=6))
def test_pieces_are_the_whole_text(texts):
    from tokenizers import Tokenizer

    encoder = token_ids._encoder(token_ids.vocabulary_file())
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    whole = Tokenizer.from_file(token_ids.vocabulary_file())
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == [i for one in want for i in one]
    assert ends.tolist() == np.cumsum([len(one) for one in want]).tolist()


def test_long_texts_go_window_by_window(plain, monkeypatch):
    monkeypatch.setattr(token_ids, "_WINDOW", 64)
    texts = [" ".join(f"word{i}" for i in range(500)), "", None, "x" * 1000 + " end<|endoftext|> more"]
    ids, _ = token_ids.Encoder(token_ids.vocabulary_file()).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [i for t in texts for i in plain(t)[:-1]]


@pytest.mark.parametrize("most", [1, 300, 4 << 20])
def test_files(spark, make, odd, plain, most):
    docs = make([*odd, (-3, "before zero"), *[(50, "again and again")] * 20])
    path = shared_dir(spark, "test-ids")
    token_ids.write_ids(docs, path, most_ids=most)
    found = token_ids.read_documents(spark, path).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    want = sorted(
        ((r[0] is not None, r[0] or 0), len(ids := plain(r[1])), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in rows
    )
    assert sorted(((r["id"] is not None, r["id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in found) == want
    at, last = 0, None
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
        key = (r["id"] is not None, r["id"] or 0)
        assert last is None or last <= key
        last = key


def test_a_document_by_its_place(spark, make, plain):
    path = shared_dir(spark, "test-ids")
    texts = [f"document {i} " * (i % 40) for i in range(700)]
    token_ids.write_ids(make(list(enumerate(texts)), parts=1).coalesce(1), path)
    raws = spark.read.format("binaryFile").load(path).filter(F.col("path").contains("/part-")).select("content")
    seen = {}
    for (raw,) in raws.collect():
        block = token_ids.Block(bytes(raw))
        assert block.ids.dtype.itemsize == 2
        for i, name in enumerate(block.names(pa.int64()).to_pylist()):
            seen[name] = block.document(i).tolist()
    assert seen == {i: plain(t) for i, t in enumerate(texts)}


def test_other_ids_and_no_rows(spark, make):
    docs = make([(i, f"text {i}") for i in range(30)])
    path = shared_dir(spark, "test-ids")
    token_ids.write_ids(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), path)
    found = token_ids.read_documents(spark, path, T.StringType()).orderBy("start")
    assert [r["id"] for r in found.collect()] == sorted(f"d{i}" for i in range(30))
    path = shared_dir(spark, "test-ids")
    token_ids.write_ids(docs.limit(0), path)
    assert token_ids.read_documents(spark, path).count() == 0
