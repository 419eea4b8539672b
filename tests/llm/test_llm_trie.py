"""The prefix trie against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from veilframe.llm import prefix_trie

ROWS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("conv", T.StringType()), T.StructField("at", T.StringType()),
    ]
)


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((t is not None, t or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    def words(p):
        return len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    total = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        total[p] = (
            sum(total[k][0] for k in kids) if kids else 1,
            sum(total[k][1] for k in kids) + (len(members[p]) - 1) * words(p),
        )
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])),
            *total[p], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found(spark, rows, base, parts=3):
    frame = spark.createDataFrame([(*r, "own", "own") for r in rows], ROWS).repartition(parts)
    turns = prefix_trie.turns(frame)
    return sorted(map(tuple, prefix_trie.trie(*prefix_trie.borrow_heads(turns), base=base).collect()), key=repr)


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 90), 100, 101, 119, 139, -5, -20, -21, 70_000, 140_003]:
        if c % 7 == 3:  # copies of one conversation
            rows += [(c, t, "user" if t % 2 else "assistant", f"copy {t}") for t in range(rng.choice([6, 6, 6, 23]))]
        else:
            for t in range(rng.choice([1, 2, 3, 5, 9, 17])):
                rows.append((c, rng.choice([None, t, t, t, t]), rng.choice(["user", "assistant", None]),
                             rng.choice(["yes", "no no", "", None, " a b\tc "])))
    return rows


@pytest.mark.parametrize("base", [1, 3, 8])
def test_trie(spark, base):
    rows = [*some_rows(base), (None, 1, "user", "belongs to none")]
    assert found(spark, rows, base) == plain(rows)


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_REACH", 2)
    monkeypatch.setattr(prefix_trie, "_IDS", 4)
    rows = [(c, t, "user", f"turn {t if t < 60 else t * c}") for c in range(20, 32) for t in range(100)]
    rows += [(c, t, "user", f"turn {t}") for c in range(32, 40) for t in range(64)]  # end at a border
    assert found(spark, rows, 2) == plain(rows)


def test_no_rows(spark):
    assert found(spark, [], 8) == []
    one = found(spark, [(20, None, None, None)], 8)
    assert one == plain([(20, None, None, None)])
