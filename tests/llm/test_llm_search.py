"""Similarity join, repeated passages, decontamination, PII and licenses by brute force."""

import hashlib
import random
import re
import textwrap
from itertools import combinations

import pytest
from conftest import PROSE
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm import components, decontaminate, jaccard_join, licenses, pii_bootstrap, suffix_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# --- components and the join --------------------------------------------------


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    edges += [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = roots({n for e in edges for n in e}, edges)
    groups = {}
    for node, root in got:
        groups.setdefault(root, set()).add(want[node])
    assert sorted(next(iter(g)) for g in groups.values()) == [0, 100, 200]
    assert all(len(g) == 1 for g in groups.values())


def shingle_set(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingle_set(r[1]) for r in rows]
    edges = []
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            edges.append((i, j))
    label = roots(range(len(rows)), edges)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def near_corpus(rng, heavy):
    """Clusters of edits, documents that share a passage, chains, short texts, copies."""
    v, rows, n = vocabulary(rng, 400), [], 0
    passage = rng.choices(v, k=60)
    for _ in range(25):
        base = rng.choices(v, k=rng.choice([3, 4, 5, 6, 8, 12, 20, 40, 90, 200]))
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = rng.choice(v)
            rows.append((n, " ".join(text)))
            n += 1
    for _ in range(heavy):  # far more than HOT documents with one passage
        rows.append((n, " ".join(rng.choices(v, k=rng.randint(60, 110)) + passage)))
        n += 1
    base = rng.choices(v, k=120)  # and one large group of near copies
    for _ in range(heavy):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(v)
        rows.append((n, " ".join(text)))
        n += 1
    rows += [(n + i, " ".join(base[: 60 + 5 * i])) for i in range(12)]  # a chain of prefixes
    rows += [(n + 20 + i, "Same words HERE") for i in range(40)]
    return rows


def test_join_equals_brute_force(make, odd, monkeypatch):
    rng = random.Random(4)
    rows = near_corpus(rng, 45) + [(r[0] and r[0] + 10_000, r[1]) for r in odd if len(r[1] or "") < 10_000]
    got = jaccard_join.near_components(make(rows, 4)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_join_with_everything_hot(make, monkeypatch):
    """With a threshold of two sets per signature the exact way for hot ones does the work."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    rows = near_corpus(random.Random(9), 12)
    got = jaccard_join.near_components(make(rows, 1)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_join_of_long_and_no_texts(make, odd):
    got = jaccard_join.near_components(make(odd)).collect()
    assert len(got) == len(odd)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (3, 4, 5)} == {3, 4, 5}
    assert jaccard_join.near_components(make([])).count() == 0


# --- repeated passages ---------------------------------------------------------


def brute_spans(rows, least):
    docs = [(r[0], split(r[1])) for r in rows]
    holders = {}
    for i, (_, w) in enumerate(docs):
        for s in range(len(w) - least + 1):
            holders.setdefault(tuple(w[s : s + least]), set()).add(i)
    out = []
    for i, (doc_id, w) in enumerate(docs):
        covered = [False] * (len(w) + 1)
        for s in range(len(w) - least + 1):
            if len({docs[j][0] for j in holders[tuple(w[s : s + least])]}) > 1:
                covered[s : s + least] = [True] * least
        start = None
        for k, c in enumerate(covered):
            if c and start is None:
                start = k
            elif not c and start is not None:
                out.append((doc_id, start, k))
                start = None
    return sorted(out, key=str)


def test_repeated_passages_equal_brute_force(make):
    rng = random.Random(11)
    v = vocabulary(rng, 300)
    passages = [rng.choices(v, k=k) for k in (49, 50, 51, 60, 140)]
    rows = []
    for i in range(60):
        text = rng.choices(v, k=rng.randint(0, 150))
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            lo = rng.randint(0, 3)
            text[at:at] = p[lo : len(p) - rng.randint(0, 3)]
        rows.append((i, " ".join(text)))
    rows += [(100, "one two " * 90), (101, "One two " * 70), (102, None), (103, ""), (104, "x " * 49)]
    rows.append(rows[3])  # a repeated row is the same document
    got = suffix_dedup.repeated_spans(make(rows)).collect()
    want = brute_spans(rows[:-1], 50)
    assert sorted({(r[0], r[1], r[2]) for r in got}, key=str) == want
    assert all(r["other"] != r["doc_id"] for r in got)


def test_repeated_passages_of_odd_rows(make, odd):
    got = suffix_dedup.repeated_spans(make(odd)).collect()
    assert {r["doc_id"] for r in got} == {1, 2, None}
    assert suffix_dedup.repeated_spans(make([])).count() == 0


# --- decontamination -----------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(rows, items):
    windows = {}
    for item, text in items:
        w = terms(text)
        size = min(13, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = terms(text), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                names = windows.get(tuple(w[s : s + size]))
                if names:
                    hit |= set(range(s, s + size))
                    found |= names
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [40, 500_000])
def test_contamination_equals_brute_force(spark, make, odd, block_words):
    rng = random.Random(2)
    v = vocabulary(rng, 120)
    items = [(i, " ".join(rng.choices(v, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(30, None), (31, ""), (None, "alpha0 beta0 gamma alpha1"), (32, "Ünïcode-éé"), (5, "gamma")]
    rows = list(odd)
    for i in range(60):
        text = rng.choices(v, k=rng.randint(0, 80))
        item = rng.choice(items)[1] or ""
        cut = item.split()[rng.randint(0, 2) :]
        text[rng.randint(0, len(text)) :] = [*cut, *rng.choices(v, k=rng.randint(0, 60))]
        rows.append((1000 + i, ", ".join(text).upper() if i % 3 else "\n".join(text)))
    found = decontaminate.search(
        make(rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words
    )
    got = decontaminate.judge(found).collect()
    assert sorted(
        ((r["id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in got), key=str
    ) == brute_contamination(rows, items)


def test_proximity_matches(spark, make):
    rng = random.Random(3)
    v = vocabulary(rng, 400)
    item = rng.choices(v, k=20)
    loose = [*item[:6], "inserted", *item[6:12], "again", *item[12:]]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    docs = make([(1, " ".join(item)), (2, " ".join(loose)), (3, " ".join(rng.choices(v, k=50)))])
    got = {r["id"]: r for r in decontaminate.judge(decontaminate.search(docs, items)).collect()}
    assert got[1]["contaminated"] and got[1]["n_hit"] == 20
    assert got[2]["n_hit"] == 0 and got[2]["n_near"] == 1
    assert got[3]["n_near"] == 0
    none = decontaminate.judge(decontaminate.search(docs, items.limit(0))).collect()
    assert [r["n_hit"] for r in none] == [0, 0, 0]
    assert decontaminate.judge(decontaminate.search(make([]), items)).count() == 0


# --- personal data -------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end())] if 14 <= len(d) <= 19 and luhn(d) else []
    for m in PHONE.finditer(text):
        out += [(m.start(), 3, m.end())] if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text("a1.9@+ -()0é4", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii_bootstrap.base_spans(text) == plain_spans(text)


@settings(max_examples=100, deadline=None)
@given(
    st.lists(
        st.sampled_from(
            ["4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "300.1.1.1", "1.2.3.4.5.6.7.8",
             "a@b.co", "x@y", "@@a@b.c@d.e", "+1 (555) 010-9999", "+12", "+1.2.3.4.5.6.7.8.9.0", "é", "  "]
        ),
        max_size=8,
    ),
    st.sampled_from(["", " ", ", "]),
)
def test_base_spans_of_joined_values(parts, glue):
    text = glue.join(parts)
    assert pii_bootstrap.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000,
                 "1 " * 100_000, "+1" + "(" * 200_000, "a@" + "b" * 200_000):
        pii_bootstrap.candidates(text, pii_bootstrap.base_spans(text))


def test_contexts_find_what_patterns_miss(make):
    rng = random.Random(8)
    v = vocabulary(rng, 300)
    talk = lambda k: " ".join(rng.choices(v, k=k))
    rows = []
    for i in range(40):
        rows.append((i, f"{talk(9)} write to user{i}@mail{i}.example {talk(6)} call me +1 (555) 01{i:02d} 234{i:02d} {talk(4)}"))
    rows.append((100, f"{talk(5)} write to someone@localhost {talk(5)}"))
    rows.append((101, f"{talk(5)} call me 555-0100-2345 now"))
    rows.append((102, f"{talk(5)} chapter two 555-0100-2345 and nobody@localhost"))
    got = {r["doc_id"]: r for r in pii_bootstrap.find(make(rows)).collect()}
    text = dict(rows)
    named = lambda i: [(s["kind"], text[i][s["start"] : s["end"]]) for s in got[i]["spans"]]
    assert named(100) == [(0, "someone@localhost")]
    assert named(101) == [(3, "555-0100-2345")]
    assert named(102) == []
    for i in range(40):
        assert got[i]["base"] == got[i]["spans"] and len(got[i]["base"]) == 2


def test_all_backed_contexts_are_used_however_few_a_pass_counts(make):
    rows = []
    for c in range(6):  # each context a little better backed than the one before
        rows += [(100 * c + i, f"so ask{c} for{c} u{c}x{i}@mail{i}.example today") for i in range(5 + c)]
        rows.append((1000 + c, f"so ask{c} for{c} someone{c}@localhost today"))
    for patterns in (1, 4, 1000):
        got = pii_bootstrap.find(make(rows), patterns=patterns).collect()
        found = {r["doc_id"]: len(r["spans"]) for r in got}
        assert found == {i: 1 for i, _ in rows}, patterns


def test_short_addresses_and_far_words_have_candidates():
    text = "host 256.1.2.3, 1.2.3.999 or 300.1.1.1. not 1.2.3 nor 256.1.2.3.4 x256.1.2.3"
    found = pii_bootstrap.candidates(text, pii_bootstrap.base_spans(text))
    assert [text[a:b] for a, b, kinds in found if pii_bootstrap.IP in kinds] == [
        "256.1.2.3", "1.2.3.999", "300.1.1.1"
    ]
    far = "no " + "x" * 900 + " at" + " " * 300 + "(" * 500 + "256.1.2.3,1.2.3.999"
    starts = [far.index("256"), far.index("1.2.3.999")]
    assert pii_bootstrap.words_before(far, starts) == ["x" * 900 + " at"] * 2
    assert pii_bootstrap.words_before("a " + "b" * 300 + "@c", [2, 202]) == [None, None]


def test_pii_of_odd_rows(make, odd):
    got = pii_bootstrap.find(make(odd)).collect()
    assert len(got) == len(odd) and all(r["base"] == [] == r["spans"] for r in got)
    assert pii_bootstrap.find(make([])).count() == 0


# --- licenses ------------------------------------------------------------------


def test_templates_are_their_own_best_match():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        found = scanner.judge(text, 0.75, 0.25)
        assert (found["license"], found["missing"], found["extra"]) == (name, "", ""), name


def test_license_blocks(make, odd):
    rows = [
        (1, "Prose here.\nReleased under the MIT License.\nMore prose."),
        (2, "This work is licensed under the GNU General Public License, version 3. And on."),
        (3, "This work is licenced under the terms of the GNU General Public License, version 3"),
        (4, "A license to ill is not a notice about anything in particular, it seems."),
        (5, "No cue at all."),
        *[(r[0] and r[0] + 100, r[1]) for r in odd],
    ]
    got = {r["doc_id"]: r for r in licenses.scan(make(rows)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["license"], got[1]["missing"], got[1]["extra"]) == ("MIT", "", "")
    assert rows[0][1][got[1]["start"] : got[1]["end"]] == "Released under the MIT License."
    assert got[2]["license"] == "GPL-3.0" and got[2]["extra"] == ""
    assert got[3]["license"] == "GPL-3.0"
    assert got[3]["extra"] == "licenced the terms of" and got[3]["missing"] == "licensed"
    assert got[4]["license"] is None
    assert licenses.scan(make([])).count() == 0


def test_every_notice_of_a_run_has_a_row(make):
    names = sorted(licenses.TEMPLATES)
    lines = [licenses.TEMPLATES[n] for n in names]
    rows = [
        (1, "Released under the MIT License. Licensed under CC BY 4.0."),
        (2, "Released under the MIT License and licensed under CC BY 4.0."),
        (3, "\n".join(lines)),
        (4, "\n".join(f"Copyright 2020 author {i}.\n" + " ".join(lines) for i in range(40))),
    ]
    got = {i: [] for i, _ in rows}
    for r in licenses.scan(make(rows)).orderBy("start").collect():
        got[r["doc_id"]].append(r)
    assert [(r["license"], r["missing"], r["extra"]) for r in got[1]] == [("MIT", "", ""), ("CC-BY-4.0", "", "")]
    assert [(r["license"], r["missing"], r["extra"]) for r in got[2]] == [("MIT", "", "and"), ("CC-BY-4.0", "", "")]
    assert [(r["license"], r["missing"], r["extra"]) for r in got[3]] == [(n, "", "") for n in names]
    assert [r["license"] for r in got[4]] == [None, *names] * 40
    text = dict(rows)[4]
    assert all(text[r["start"] : r["end"]] in lines for r in got[4] if r["license"])


def test_wrapped_and_commented_notices(make):
    rows, want = [], {}
    for sign in ("", " * ", "# ", "// ", "-- ", "dnl "):
        for width in (20, 60, 70, 80):
            for name, text in licenses.TEMPLATES.items():
                wrapped = textwrap.wrap(
                    f"This file is a part of the frob toolkit, see there. {text}", width,
                    break_long_words=False, break_on_hyphens=False,
                )
                full = "\n".join(sign + line for line in ["All about frobs.", "", *wrapped, "", "Frobs follow."])
                want[len(rows)] = name
                rows.append((len(rows), full))
    got = {i: [] for i in want}
    for r in licenses.scan(make(rows)).collect():
        got[r["doc_id"]].append((r["license"], r["missing"]))
    for i, name in want.items():
        assert got[i] == [(name, "")], rows[i][1]


def test_digest_of_nothing_is_that_of_an_empty_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
    assert len(PROSE.split()) == 120
