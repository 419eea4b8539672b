"""Long term lists against a plain search."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from veilframe.operators import term_index, terms


def plain(text, listed):
    """Every term's own occurrences, the longest term first."""
    fold = lambda t: "".join(map(chr, term_index.folded(t)))
    here, out = fold(text), []
    for term in sorted({fold(t) for t in listed if t}, key=lambda t: (-len(t), t)):
        at = here.find(term)
        while at >= 0:
            out.append((at, at + len(term), text[at : at + len(term)]))
            at = here.find(term, at + len(term))
    return out


def found(index, text):
    start, term = index.find(term_index.folded(text))
    length = index.starts[term + 1] - index.starts[term]
    return [(s, s + n, text[s : s + n]) for s, n in zip(start.tolist(), length.tolist())]


LETTERS = st.text(st.sampled_from("aAbB kKsSßẞıİéÉ￿😀"), max_size=24)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.lists(LETTERS, max_size=12))
def test_index(text, listed):
    assert found(term_index.TermIndex.of(listed), text) == plain(text, listed)


def test_windows_and_long_terms(monkeypatch):
    monkeypatch.setattr(term_index, "_WINDOW", 50)
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(3000))
    listed = [text[i : i + n] for i, n in ((10, 200), (1500, 49), (1499, 51), (2990, 10))] + ["ab", "aa", "bab" * 3]
    assert found(term_index.TermIndex.of(listed), text) == plain(text, listed)


def test_letters_compare_as_a_pattern_does():
    codes = term_index.folded("KſİıÅΩµẞ")
    assert np.array_equal(codes, term_index.folded("ksiiåωμß"))


def test_hashes_do_not_decide(monkeypatch):
    monkeypatch.setattr(term_index, "_hash", lambda sums, starts, lengths: np.zeros(len(starts), np.uint64) + np.uint64(7))
    assert found(term_index.TermIndex.of(["one", "two", "three"]), "One, two, tree") == [(0, 3, "One"), (5, 8, "two")]


ROWS = T.StructType(
    [T.StructField("i", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.StringType())]
)


@pytest.mark.parametrize("block", [500_000, 3])
def test_rows(spark, block):
    listed = ["Customer 1", "customer 12", "customer 120", "er 1", "zzz", "", None, "aba"]
    rows = [
        (1, "Ask CUSTOMER 120 or customer 1.", "own"), (1, "Ask CUSTOMER 120 or customer 1.", "own"),
        (2, None, None), (3, "", None), (None, "order 1", None), (None, "ababa", None), (4, "x" * 100_000 + " zZz", None),
    ]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    names = spark.createDataFrame([(t,) for t in listed], "term string")
    got = terms.term_spans(df, "i", "text", names, block_terms=block).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = [(s["start"], s["end"], s["value"]) for s in r["spans"]]
        assert spans == plain(r["text"] or "", [t for t in listed if t])
    plan = terms.term_spans(df, "i", "text", names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the test's own repartition


def test_no_terms(spark):
    df = spark.createDataFrame([(1, "some text", "own")], ROWS)
    assert terms.term_spans(df, "i", "text", spark.createDataFrame([], "term string")).first()["spans"] == []


def test_a_long_list_takes_one_pass_over_the_texts(spark):
    """However long the list, texts are read by one Python pass and joined once."""
    names = spark.range(5000).selectExpr("'Term ' || id as term")
    texts = [f"x TERM {i * 37} and term {i} term" for i in range(60)] + ["term 4", "term"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = terms.term_spans(df, "i", "text", names, block_terms=50)
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    listed = [f"term {i}" for i in range(5000)]
    for r in got.collect():
        assert [(s["start"], s["end"], s["value"]) for s in r["spans"]] == plain(r["text"], listed)
