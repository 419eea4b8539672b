"""Candidates of personal data: linear in one text, and equal to the plain patterns."""

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import pii_bootstrap

PLAIN = re.compile(r"[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9][A-Za-z0-9.-]*")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "@", "(at)", "[at]", "-", " ", "9", "(", "at", "é", "@@"]), max_size=30))
def test_handles_equal_the_pattern(parts):
    text = "".join(parts)
    assert pii_bootstrap.handles(text) == [m.span() for m in PLAIN.finditer(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=8), st.integers(0, 45), st.integers(1, 9))
def test_clear_of_base_spans(base, start, length):
    spans = sorted((s, 0, s + n) for s, n in base)
    end = start + length
    assert pii_bootstrap.clear_of(spans)(start, end) == all(end <= s or e <= start for s, _, e in spans)


def test_one_long_text_is_linear():
    began = time.monotonic()
    text = "x" * 1_000_000 + " @ " + "y" * 1_000_000 + "@"
    assert pii_bootstrap.candidates(text, pii_bootstrap.base_spans(text)) == []
    many = " ".join(f"a{i}@b.co call 555 010 {i:04d}" for i in range(20_000))
    base = pii_bootstrap.base_spans(many)
    assert len(base) == 20_000 and pii_bootstrap.candidates(many, base)
    assert time.monotonic() - began < 20
