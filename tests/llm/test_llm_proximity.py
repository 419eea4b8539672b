"""Proximity matches against plain Python: words put in, left out and replaced."""

import random
from collections import Counter, defaultdict

from veilframe.llm import decontaminate

WIDTH, SLACK = 13, 3


def brute_near(rows, items):
    often = Counter(w for _, text in rows for w in text.split())
    out = {}
    for doc_id, text in rows:
        doc, near = text.split(), set()
        places_of = defaultdict(list)
        for p, w in enumerate(doc):
            places_of[w].append(p)
        for item, item_text in items:
            ws = item_text.split()
            size = min(WIDTH, len(ws))
            if any(ws[s : s + size] == doc[p : p + size] for s in range(len(ws) - size + 1) for p in range(len(doc))):
                continue
            probes = set()
            for s in range(len(ws) - size + 1):
                there = [p for p in range(s, s + size) if often[ws[p]]]
                if len(there) >= min(2, size):
                    probes |= set(sorted(there, key=lambda p: (often[ws[p]], p))[:2])
            diagonals = defaultdict(set)
            for place in probes:
                for p in places_of[ws[place]]:
                    diagonals[p - place].add(place)
            order = sorted(diagonals)
            if any(len(diagonals[d]) >= min(2, size) for d in order) or any(
                b - a <= SLACK and len(diagonals[a] | diagonals[b]) > max(len(diagonals[a]), len(diagonals[b]), 1)
                for a, b in zip(order, order[1:])
            ):
                near.add(str(item))
        out[doc_id] = sorted(near)
    return out


def test_edited_items_equal_brute_force(spark, make):
    rng = random.Random(9)
    v = [f"w{i}" for i in range(900)]
    items = [(i, " ".join(rng.choices(v, k=rng.choice([5, 13, 20, 40])))) for i in range(30)]
    items.append((30, " ".join(["absent", *v[:14], "missing"])))
    rows, edited = [], {}
    for i in range(120):
        item, text = rng.choice(items)
        w = text.split()
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[], [w[at], "inserted"], ["replaced"]])
        edited[i] = str(item)
        rows.append((i, " ".join([*rng.choices(v, k=rng.randint(0, 60)), *w, *rng.choices(v, k=20)])))
    rows.append((500, " ".join(v[:14])))
    found = decontaminate.search(make(rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {r["id"]: r for r in decontaminate.judge(found).collect()}
    want = brute_near(rows, items)
    assert {i: list(r["near"]) for i, r in got.items()} == want
    assert all(r["n_near"] == len(r["near"]) for r in got.values())
    caught = sum(name in got[i]["near"] or name in got[i]["items"] for i, name in edited.items())
    assert caught >= 0.8 * len(edited)
    assert "30" in got[500]["items"] or "30" in got[500]["near"]
