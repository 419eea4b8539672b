"""Licenses: neighbours keep apart, and ranking by compression loses nothing that wording confirms."""

import random
import time

import pytest

from veilframe.llm import licenses

SHARE, CLOSE = 0.75, 0.25


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def names(scanner, text):
    return [r["license"] for r in scanner.notices(text, SHARE, CLOSE)]


def test_identifiers_and_templates_name_themselves(scanner):
    for name in licenses.IDENTIFIERS:
        for text in (f"// SPDX-License-Identifier: {name}\nint main();", f"SPDX-License-Identifier: {name.upper()}"):
            assert names(scanner, text) == [name]
    for name, text in licenses.TEMPLATES.items():
        assert names(scanner, text) == [name]
        assert names(scanner, text.upper()) == [name]


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.", "LGPL"),
        ("This work is licensed under the GNU General Public License, version 4.", "GPL"),
        ("This work is licensed under the GNU General Public License v3.0.", "GPL-3.0"),
        ("This work is not licensed under the GNU General Public License, version 3.", None),
        ("This work is not licensed under CC BY 4.0.", None),
        ("Licensed under CC-BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 3.0.", None),
        ("Released under the Apache License.", None),
        ("SPDX-License-Identifier: MIT-0", None),
        ("SPDX-License-Identifier: GPL-2.0+", None),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT"),
        (licenses.TEMPLATES["BSD"], "BSD"),
    ],
)
def test_neighbours(scanner, text, want):
    assert names(scanner, text) == [want]


def test_every_pair_of_templates_keeps_apart(scanner):
    """A word of one template put in place of another's never gives a third license's name."""
    for name, t in scanner.templates.items():
        if t.tag:
            continue
        for w in t.telling:
            text = " ".join(x for x in licenses.TEMPLATES[name].split() if w not in licenses.forms(x))
            assert name not in names(scanner, text), (name, w)


def brute(scanner, text):
    """All templates compared with the whole text, no compression."""
    starts = licenses.np.array(licenses.sentences(text)).T[0]
    found = scanner._words(text, starts)
    todo, out = [(0, len(found.form))], []
    while todo:
        lo, hi = todo.pop()
        spans = []
        for t in scanner.templates.values():
            for a, b in scanner.alignments(found.code[lo:hi], t.codes, SHARE) if lo < hi else []:
                d = scanner.confirm(text, found, t, lo + a, lo + b, SHARE)
                if d:
                    matched = len(t.words) - len(d[0])
                    spans.append((len(d[0]) - matched, -matched, len(d[1]), t.key, lo + a, lo + b))
        taken = []
        for *_, key, a, b in sorted(spans):
            if all(b <= c or d <= a for c, d, _ in taken):
                taken.append((a, b, scanner.templates[key].license))
        out += taken
        cuts = sorted(x for a, b, _ in taken for x in (a, b))
        edges = [lo, *cuts, hi]
        todo += [(a, b) for a, b in zip(edges[::2], edges[1::2]) if taken and a < b]
    return [n for _, _, n in sorted(out)]


def test_ranking_loses_nothing(scanner):
    rng = random.Random(4)
    prose = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ondi", "area", "ulte", "isso", "yn")]
    pool = list(licenses.TEMPLATES.values()) + [f"SPDX-License-Identifier: {i}" for i in licenses.IDENTIFIERS]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(" ".join(rng.choices(prose, k=rng.randint(3, 60))).capitalize() + ".")
            w = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 0, 1])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [w[at], "ulteondi"], ["ulteondi"]])
            parts.append(" ".join(w) + rng.choice([".", "\n"]))
        text = rng.choice([" ", "\n"]).join(parts)
        got = [n for n in names(scanner, text) if n]
        assert got == brute(scanner, text), text


def test_a_run_without_notices_is_one_row_in_linear_time(scanner):
    took = []
    for n in (2_000, 8_000):
        began = time.perf_counter()
        text = "".join(f"Copyright 2020 by author {i}.\n" for i in range(n))
        assert [(r["license"], r["start"]) for r in scanner.notices(text, SHARE, CLOSE)] == [(None, 0)]
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


def test_null_ids_and_odd_texts(make):
    rows = [(None, "Released under the MIT License."), (None, None), (1, ""), (2, "Copyright"), (2, "Copyright")]
    got = sorted(((r["doc_id"], r["license"]) for r in licenses.scan(make(rows)).collect()), key=str)
    assert got == [(2, None), (2, None), (None, "MIT")]
