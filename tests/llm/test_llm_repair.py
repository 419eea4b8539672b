"""Conversation repair against a plain search over all edits."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import types as T

from veilframe.llm import conv_repair

ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("ck", T.StringType()), T.StructField("pos", T.StringType()),
    ]
)
WHITE = " \t\n\x0b\x0c\r"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """The least (cost, audit) with its lines, by a search over edits in order of cost and letters."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen, tick = [(0, "", 0, "", ())], set(), itertools.count()
    name = {"u": "user", "a": "assistant"}
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (i, last) in seen:
            continue
        seen.add((i, last))
        nxt = after[last]
        heapq.heappush(heap, (cost + 5, audit + "I", i, nxt, (*lines, name[nxt] + ":")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                if role[:1] == nxt or (role[:1] == "s" and last == ""):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + extra, audit + "R", i + 1, nxt, (*lines, f"{name[nxt]}:{text}")))
    raise AssertionError


def plain(rows):
    """What ``repair`` says of one conversation's (turn, role, text)."""
    def key(r):
        turn, role, text = r
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        return (turn is not None, turn or 0, digest)

    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=key)
    seen, judged, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        fault = "blank" if not end else "duplicate" if (role, text) in seen else None
        if fault is None and end[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        judged.append((role, text, fault))
    cost, audit, lines = cheapest(judged)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **counts, "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "own", "own") for r in rows], ROWS).repartition(parts)


def random_rows(seed, convs=60, most=40):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for _ in range(rng.randrange(1, most)):
            rows.append((
                c, rng.choice([None, *range(12)]),
                rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                rng.choice(["Yes.", "No!", "and so", "", " \n", None, "Why?\n ", f"n{rng.randrange(99)}."]),
            ))
    return rows


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_repair(spark, chunk):
    rows = random_rows(chunk)
    rows += [(None, 1, "user", "Hm."), (None, None, None, None)]
    rows += [(-7, t, "user", "Hello.") for t in range(150)]  # one row over and over
    found = {r["ck"]: r for r in conv_repair.repair(frame(spark, rows), chunk_bytes=chunk).collect()}
    groups = {}
    for c, *row in rows:
        groups.setdefault("n" if c is None else f"i{c}", []).append(row)
    assert set(found) == set(groups)
    for ck, group in groups.items():
        assert {c: found[ck][c] for c in COUNTS} == plain(group), ck


def test_scans_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(conv_repair, "_FAN", 3)
    rows = [(5, t, "user" if t % 3 else "assistant", f"Turn {t}." if t % 7 else "cut") for t in range(200)]
    rows += [(6, t, "user", "One.") for t in range(2)]
    found = {r["ck"]: r for r in conv_repair.repair(frame(spark, rows), chunk_bytes=500).collect()}
    for ck, c in (("i5", 5), ("i6", 6)):
        assert {k: found[ck][k] for k in COUNTS} == plain([r[1:] for r in rows if r[0] == c])


def test_powers_advance_runs():
    symbols = "u" * 1000 + "x" * 37 + "A" * 512 + "s"
    after = conv_repair.END
    for s in reversed(symbols):
        after = conv_repair._before(s, 1, after)
    costs, choices = conv_repair.unroll(symbols, conv_repair.END)
    assert costs == after and len(choices) == len(symbols)
    assert tuple((conv_repair.matrix(symbols) + conv_repair.END).min(axis=1)) == after


def test_all_ids_come_back(spark):
    ids = frame(spark, [(1, 0, "user", "Hi."), (2, 0, None, None), (None, None, None, None)])
    found = {r["conv_id"]: r for r in conv_repair.repair_all(frame(spark, [(1, 0, "user", "Hi.")]), ids).collect()}
    assert set(found) == {1, 2, None}
    assert found[1]["audit"] == "D" and found[1]["cost"] == 2
    for c in (2, None):
        assert found[c]["audit"] == "" and found[c]["cost"] == 0
        assert found[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    empty = frame(spark, [(1, 0, "user", "Hi.")]).limit(0)
    assert conv_repair.repair_all(empty, empty).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in (None, 0, 1)]
    rows += [(None, 3, None, None)]
    got = sorted(map(repr, (tuple(r) for r in conv_repair.damage(frame(spark, rows)).collect())))
    want = []
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        role = "user" if kind == 4 else role
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(map(repr, want))
