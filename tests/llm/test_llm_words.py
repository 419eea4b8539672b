"""The vectorised words against a plain split."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import jaccard_join, suffix_dedup, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text("abZ é09-_\t\n\x0b.中", max_size=80)), max_size=12)


@pytest.mark.parametrize(
    "table,pattern",
    [(words.BLANKS, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")],
)
@pytest.mark.parametrize("piece", [16, 1 << 20])
@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_words_are_those_of_the_pattern(table, pattern, piece, texts):
    before = words.PIECE
    words.PIECE = piece
    try:
        found = words.words(pa.array(texts, pa.string()), table)
    finally:
        words.PIECE = before
    names = {}
    for i, text in enumerate(texts):
        plain = re.findall(pattern, (text or "").translate(LOWER))
        assert len(plain) == len(found.of(i))
        for word, h in zip(plain, found.of(i), strict=True):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


def test_batches_are_cut_by_bytes():
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["a" * 10, None, "b" * 30, "", "c"])], names=["text"]
    )
    cut = list(words.slices(iter([batch]), "text", most=12))
    assert sum(b.num_rows for b in cut) == 5
    assert [b.column(0).to_pylist() for b in cut][0] == ["a" * 10, None]


def test_shingles_of_short_texts():
    doc = np.array([5, 6, 7], dtype=np.uint64)
    assert len(words.shingles(doc, 5)) == 1
    assert words.shingles(doc, 5)[0] != words.shingles(doc[:2], 5)[0]
    assert len(words.shingles(doc[:0], 5)) == 0


def test_equal_runs_hash_equal_wherever_they_stand():
    rng = np.random.default_rng(0)
    doc = rng.integers(0, 2**63, 400, dtype=np.uint64)
    doc[300:360] = doc[20:80]
    found = suffix_dedup.runs(doc, 50)
    assert (found[300:311] == found[20:31]).all()
    assert len(np.unique(found)) == len(found) - 11


@settings(max_examples=150, deadline=None)
@given(
    common=st.integers(1, 120), left=st.integers(0, 20), right=st.integers(0, 20),
    seed=st.integers(0, 10**6),
)
def test_similar_sets_share_a_signature(common, left, right, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**63, common + left + right, dtype=np.uint64)
    a, b = np.sort(pool[: common + left]), np.sort(np.concatenate([pool[:common], pool[common + left :]]))
    if left + right == 0 or 100 * common < 75 * len(pool):
        return
    scheme, got = jaccard_join.Scheme(), []
    for s in (a, b):
        per_code = {}
        for sigs, owner, _, code in jaccard_join.all_signatures([s], scheme):
            for o, c in enumerate(code):
                name = c & ((1 << jaccard_join._SPARE_AT) - 1)
                per_code[name] = (set(sigs[owner == o].tolist()), c >> jaccard_join._SPARE_AT)
        got.append(per_code)
    shared = {
        n: len(got[0][n][0] & got[1][n][0]) for n in got[0].keys() & got[1].keys()
    }
    assert any(shared.values())
    # what an entry has to spare is a lower bound of what it shares
    assert any(
        shared[n] >= max(1, got[0][n][1], got[1][n][1]) for n in shared
    )
