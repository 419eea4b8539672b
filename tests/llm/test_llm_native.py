"""Mixing, sharding and exact deduplication against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact_dedup, mixing, queries, sharding
from veilframe.llm.oracles import oracle_queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights, cap):
    """Reshare what full sources leave, until none is above its cap."""
    total, target = sum(sizes.values()), {}
    open_ = set(sizes)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix(make, odd):
    rows = mixing.mix(make(odd)).collect()
    assert len(rows) == len(odd)
    sizes = defaultdict(int)
    for _, text, _, source in odd:
        sizes[source] += size_of(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = fill(sizes, weights, 3)
    taken = defaultdict(int)
    for r in rows:
        assert r["size"] == size_of(r["text"])
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_training_order_follows_the_schedule(make):
    docs = make([(i, "w " * 50, "en", "abc"[i % 3]) for i in range(1500)])
    mixed = mixing.mix(docs)
    order = mixing.training_order(mixed).select("position", "source", "words").collect()
    assert [r[0] for r in order] == sorted(r[0] for r in order)
    assert sum(r[2] for r in order) == mixed.agg(F.sum("taken")).first()[0]
    early = [r[1] for r in order if r[0] < 0.1]
    late = [r[1] for r in order if r[0] > 0.9]
    assert early.count("a") > 2 * late.count("a") > 0  # fades
    assert late.count("c") > 2 * early.count("c") > 0  # grows


def test_uneven_schedule_has_its_area_as_weight():
    bent = mixing.Schedule(((0.0, 0.0), (0.25, 4.0), (1.0, 0.0)))
    assert bent.area() == pytest.approx(2.0)
    assert [s[4] for s in bent.segments()] == [0.0, 0.5]


def test_shard(make, odd):
    rows = sharding.shard(make(odd)).collect()
    assert len(rows) == len(odd)
    slots = defaultdict(list)
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 1
        assert r["text_crc32"] == (None if r["text"] is None else zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
    for got in slots.values():
        assert sorted(got) == list(range(len(got)))
    placed = defaultdict(set)
    for r in rows:
        placed[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(p) == 1 for p in placed.values())


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20_000).withColumn("text", F.lit("t"))
    rows = sharding.shard(ids, id_col="id").groupBy("shard", "grown_shard").count().collect()
    counts = defaultdict(int)
    for a, b, n in rows:
        assert b in (a, 8)
        counts[a] += n
    assert all(2200 < n < 2800 for n in counts.values())
    assert 2000 < sum(n for _, b, n in rows if b == 8) < 2450
    # a heavier shard draws rows to its own region, and within others nothing moves
    heavier = {**sharding.EIGHT, "north": {"a": {0: 3.0, 1: 1.0}, "b": {2: 1.0, 3: 1.0}}}
    moved = (
        sharding.shard(ids, id_col="id", grown=heavier)
        .filter("shard <> grown_shard").select("shard", "grown_shard").distinct().collect()
    )
    assert moved and all(b in (0, 1, 2, 3) for _, b in moved)
    shares = (
        sharding.shard(ids, id_col="id", shape=heavier, grown=None).groupBy("shard").count().collect()
    )
    assert 5300 < dict(shares)[0] < 6700  # 3 of 10


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(F.md5(c), 1, 1)])
def test_copies(make, odd, digest):
    rows = [*odd, (20, "ABC é É", "en", "a"), (21, "abc é É", "en", "a"), (22, "abc é é", "en", "a")]
    got = exact_dedup.mark_copies(make(rows), digest=digest).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(LOWER)].append(doc_id)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        members = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(members)
        known = [m for m in members if m is not None]
        assert r["keep_id"] == (max(known) if known else None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept) == set(by_sha) and set(kept.values()) == {1}


def test_empty_tables(make):
    none = make([])
    assert mixing.mix(none).count() == 0
    assert mixing.training_order(mixing.mix(none)).count() == 0
    assert sharding.shard(none).count() == 0
    assert exact_dedup.mark_copies(none).count() == 0


def test_every_sql_has_its_query():
    assert oracle_queries().keys() <= queries.all_queries().keys()
