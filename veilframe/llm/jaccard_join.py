"""Similarity join of documents on word shingles by PartEnum signatures.

A document's set is its distinct runs of ``shingle`` words. Two sets of m <= n
elements with a Jaccard similarity of at least T % differ in at most
(m + n)(100 - T) / (100 + T) elements, and n is at most 100 m / T. Sizes are
therefore cut into bands so that partners lie in one band or in neighbouring
ones; the instance of a band joins it with itself and the next, under one bound
k on the difference.

Per instance the feature domain is hashed into ``n1`` first-level partitions and
each of these into ``n2`` parts. Every subset of n2 - k2 parts of a partition,
projected, is a signature. A partition with k2 differences or fewer has a subset
without any, so k differences leave equal signatures if there are partitions
enough. Equal signatures make candidates.

What makes this exact on any data:

* A signature of no elements says nothing and isn't sent. To spoil all others of
  a partition takes k2 + 1 differences, or one per part that has elements if
  those are fewer. A set adds this up; with more than k no partner is missed. A
  set with less also signs under the next seed, and so on: a pair lost under one
  seed has both sides short there, and so both sign under the next.
* A signature that more than ``HOT`` sets share (a passage that many documents
  have, a large group of near copies) is joined with one hub only, which is linear.
  Each takes at most one from the sum above; a pair that shares no other
  signature has both sides left with k or less. Only such sets are compared
  further, and only across components.

What is left over from the bound is also a filter: a partner shares at least that
many signatures, so sets that share fewer with all others together have none.

Then two rounds of verification by whole sets: hubs against members, and, after
contraction into components, what is still in different components. Equal sets
count once, by a 128-bit digest. Hot signatures are cut down to a hub in each
map task, so that no group holds a part of them that grows with a group of
near copies beyond ``HOT`` per batch of about 16 MB.

Defined results: null, empty and blank texts have an empty set, link with
nothing and are their own component; repeated ids are rows of their own and are
named by their id; a null id has a component like any other, and the smallest id
leaves nulls out; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm import words
from veilframe.llm.components import components
from veilframe.sources.workdir import materialise

HOT = 32
_FLUSH = 1_000_000  # signatures in hand
_SLICE = 3 << 20  # bytes of text in hand
_BLOCK = 65_536  # elements of a block of sets
_SEEDS = 16
_SPARE_AT = 11  # bits of a code below its spare: bands times seeds stay below 2048
_MOST_SPARE = (1 << 20) - 1


@dataclass(frozen=True)
class Instance:
    """The join of band ``band`` with itself and the next one."""

    band: int
    k: int
    n1: int
    n2: int
    k2: int


@dataclass(frozen=True)
class Scheme:
    """Bands and instances for a threshold in percent."""

    percent: int = 75
    shingle: int = 5
    n2: int = 2
    k2: int = 1
    slack: float = 1.75

    def band_starts(self, largest: int) -> list[int]:
        starts = [1]
        while starts[-1] <= largest:
            starts.append(starts[-1] * 100 // self.percent + 1)
        return starts

    def instance(self, band: int, starts: list[int]) -> Instance:
        top = starts[band + 1] - 1
        k = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        n1 = int((k + 1) / (self.k2 + 1) * self.slack) + 2
        return Instance(band, k, n1, self.n2, self.k2)


def document_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    found = words.words(texts, words.BLANKS)
    return [np.unique(words.shingles(found.of(i), shingle)) for i in range(len(found))]


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, whatever the order; as two signed numbers."""
    n = np.array([len(elements)], dtype=np.uint64)  # an array: sums may wrap around
    a = words.mixed(elements ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    b = words.mixed(elements + np.uint64(0x0123456789ABCDEF)).sum(dtype=np.uint64)
    both = words.mixed(np.concatenate([n + a, n ^ b])).view(np.int64)
    return int(both[0]), int(both[1])


def signatures(
    sets: list[np.ndarray], which: np.ndarray, inst: list[Instance], seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of entries (set ``which[i]`` in instance ``inst[i]``) under a seed.

    Returns the signatures, the entry of each, and by how many differences it
    takes more than the instance's bound to spoil all of an entry's signatures.
    """
    n2, k2 = inst[0].n2, inst[0].k2
    n1 = np.array([x.n1 for x in inst], dtype=np.int64)
    salt = words.mixed(
        np.array([x.band * _SEEDS + seed for x in inst], dtype=np.uint64) + np.uint64(77)
    )
    sizes = np.array([len(sets[w]) for w in which], dtype=np.int64)
    elements = np.concatenate([sets[w] for w in which])
    owner = np.repeat(np.arange(len(which)), sizes)
    x = words.mixed(elements ^ salt[owner])
    first = np.concatenate([[0], np.cumsum(n1)])  # first partition of each entry
    part = first[owner] + ((x >> np.uint64(32)).astype(np.int64) % n1[owner])
    cell = part * n2 + (x & np.uint64(0xFFFFFFFF)).astype(np.int64) % n2
    total = int(first[-1])
    sums = np.zeros(total * n2, dtype=np.uint64)
    np.add.at(sums, cell, words.mixed(x + np.uint64(0x51ED270B)))
    counts = np.bincount(cell, minlength=total * n2).reshape(total, n2)
    sums = sums.reshape(total, n2)
    who = np.repeat(np.arange(len(which)), n1)
    base = words.mixed(
        salt[who] + (np.arange(total) - first[who]).astype(np.uint64) * np.uint64(64)
    )
    found, owners = [], []
    for nth, left_out in enumerate(combinations(range(n2), k2)):
        keep = [q for q in range(n2) if q not in left_out]
        some = counts[:, keep].sum(axis=1) > 0
        of = sums[:, keep].sum(axis=1, dtype=np.uint64)[some]
        found.append(words.mixed(of ^ (base[some] + np.uint64(nth))))
        owners.append(who[some])
    cost = np.minimum((counts > 0).sum(axis=1), k2 + 1)
    spare = np.add.reduceat(cost, first[:-1]) - np.array([x.k for x in inst])
    return np.concatenate(found), np.concatenate(owners), spare


def entries(sizes: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, list[Instance]]:
    """Which sets sign in which instances: their own band's and the one below."""
    if not len(sizes) or sizes.max() < 1:
        return np.zeros(0, dtype=np.int64), []
    starts = scheme.band_starts(int(sizes.max()))
    bands = np.searchsorted(starts, sizes, side="right") - 1
    cache: dict[int, Instance] = {}
    which, inst = [], []
    for i, band in enumerate(bands):
        for b in (band, band - 1):
            if b >= 0:
                if b not in cache:
                    cache[b] = scheme.instance(int(b), starts)
                if cache[b].k > 0:  # else only equal sets are partners
                    which.append(i)
                    inst.append(cache[b])
    return np.array(which, dtype=np.int64), inst


def all_signatures(
    sets: list[np.ndarray], scheme: Scheme
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(signatures, the entry of each, each entry's set and code), seed by seed.

    ``code`` holds band, seed and what the entry has to spare over the bound. With
    nothing to spare it signs again under the next seed.
    """
    which, inst = entries(np.array([len(s) for s in sets]), scheme)
    for seed in range(_SEEDS):
        if not len(which):
            return
        sigs, owner, spare = signatures(sets, which, inst, seed)
        name = np.array([x.band * _SEEDS + seed for x in inst], dtype=np.int32)
        yield sigs, owner, which, name | (np.clip(spare, 0, _MOST_SPARE).astype(np.int32) << _SPARE_AT)
        again = np.flatnonzero(spare <= 0)
        which, inst = which[again], [inst[i] for i in again]


# --- in tasks -----------------------------------------------------------------

# Packed: signatures, and per entry how many of them, its ref and its code.
_BLOB = "bucket int, sigs binary, counts binary, refs binary, codes binary, hot binary"
_MEMBER = "g long, code int, ref long"


def _task_sets(scheme: Scheme):
    """(id, th, text) -> (id, th, n, d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            sets = document_sets(batch.column(2), scheme.shingle)
            d = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([x[0] for x in d], pa.int64()),
                    pa.array([x[1] for x in d], pa.int64()),
                ],
                names=["id", "th", "n", "d1", "d2"],
            )

    return run


def _local(sig, owner, refs, codes) -> tuple[np.ndarray, np.ndarray, list]:
    """Cut groups of more than HOT entries down to their hub.

    Returns which signatures go on, which of them are hot, and the members of the
    groups that were cut.
    """
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    size = np.diff(np.concatenate([start, [len(s)]]))
    go, hot, members = np.ones(len(sig), dtype=bool), np.zeros(len(sig), dtype=bool), []
    for at, n in zip(start[size > HOT], size[size > HOT], strict=True):
        rows = order[at : at + n]
        own = refs[owner[rows]]
        hub = rows[np.argmin(own)]
        go[rows] = False
        go[hub] = hot[hub] = True
        members.append((np.full(n, s[at]), codes[owner[rows]], own))
    return go, hot, members


def _bucket_of(sig: np.ndarray, buckets: int) -> np.ndarray:
    return ((sig >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _group_id(sig: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the low 32 bits: what candidates agree in."""
    low = (sig & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (_bucket_of(sig, buckets).astype(np.int64) << 32) | low


def _task_signatures(scheme: Scheme, buckets: int):
    """(text) -> rows of packed signatures per bucket, and of members of hot groups."""

    def flush(parts) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([p[0] for p in parts])
        base = np.cumsum([0] + [len(p[2]) for p in parts])
        owner = np.concatenate([p[1] + b for p, b in zip(parts, base, strict=False)])
        refs = np.concatenate([p[2] for p in parts])
        codes = np.concatenate([p[3] for p in parts])
        go, hot, members = _local(sig, owner, refs, codes)
        out = {"bucket": [], "sigs": [], "counts": [], "refs": [], "codes": [], "hot": []}
        if members:  # spread over buckets of their own, passed through
            g, c, r = (np.concatenate(x) for x in zip(*members, strict=True))
            g = _group_id(g, buckets)
            for at in range(0, len(g), 100_000):
                cut = slice(at, at + 100_000)
                out["bucket"].append(buckets + int(words.mixed(r[cut][:1].view(np.uint64))[0] % np.uint64(buckets)))
                out["sigs"].append(g[cut].tobytes())
                out["counts"].append(None)
                out["refs"].append(r[cut].tobytes())
                out["codes"].append(c[cut].astype(np.int32).tobytes())
                out["hot"].append(None)
        sig, owner, hot = sig[go], owner[go], hot[go]
        bucket = _bucket_of(sig, buckets)
        order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
        sig, owner, hot, bucket = sig[order], owner[order], hot[order], bucket[order]
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist()
        for lo, hi in zip(edge, edge[1:] + [len(bucket)], strict=True):
            o = owner[lo:hi]
            new = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            own = o[new]
            out["bucket"].append(int(bucket[lo]))
            out["sigs"].append((sig[lo:hi] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            out["counts"].append(np.diff(np.append(new, len(o))).astype(np.uint32).tobytes())
            out["refs"].append(refs[own].tobytes())
            out["codes"].append(codes[own].astype(np.int32).tobytes())
            out["hot"].append(np.flatnonzero(hot[lo:hi]).astype(np.uint32).tobytes())
        kinds = (pa.int32(), *[pa.binary()] * 5)
        for at in range(0, len(out["bucket"]), 2000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[at : at + 2000], t) for v, t in zip(out.values(), kinds, strict=True)],
                names=list(out),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for batch in words.slices(batches, "text", _SLICE):
            sets, refs = [], []
            for s in document_sets(batch.column(0), scheme.shingle):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    sets.append(s)
                    refs.append(d[0])
            refs = np.array(refs, dtype=np.int64)
            for sig, owner, which, code in all_signatures(sets, scheme):
                parts.append((sig, owner, refs[which], code))
                held += len(sig)
            if held >= _FLUSH:
                yield from flush(parts)
                parts, held = [], 0
        if held:
            yield from flush(parts)

    return run


def _members(sig, ref, code, hot, bucket: int):
    """Members of the groups of one bucket that hold two sets or more, or a hot hub."""
    order = np.argsort(sig)
    s = sig[order]
    same = s[1:] == s[:-1]
    some = hot[order]
    some[1:] |= same
    some[:-1] |= same
    rows = order[some]
    rows = rows[np.lexsort((ref[rows], sig[rows]))]
    sig, ref, code, hot = sig[rows], ref[rows], code[rows], hot[rows]
    again = np.zeros(len(rows), dtype=bool)
    again[1:] = (sig[1:] == sig[:-1]) & (ref[1:] == ref[:-1])
    start = np.flatnonzero(~again)
    hot = np.logical_or.reduceat(hot, start) if len(start) else hot
    sig, ref, code = sig[start], ref[start], code[start]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else start
    size = np.diff(np.append(first, len(sig)))
    any_hot = np.logical_or.reduceat(hot, first) if len(first) else hot
    keep = np.repeat((size > 1) | any_hot, size)
    g = (np.int64(bucket) << 32) | sig.astype(np.int64)
    return g[keep], code[keep], ref[keep]


def _task_groups(buckets: int):
    """All rows of one bucket -> its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, ref, code, hot, bucket = [], [], [], [], -1
        for batch in batches:
            for row in batch.to_pylist():
                bucket = row["bucket"]
                refs = np.frombuffer(row["refs"], np.int64)
                codes = np.frombuffer(row["codes"], np.int32)
                if bucket >= buckets:
                    yield _member_batch(np.frombuffer(row["sigs"], np.int64), codes, refs)
                    continue
                s, counts = np.frombuffer(row["sigs"], np.uint32), np.frombuffer(row["counts"], np.uint32)
                mark = np.zeros(len(s), dtype=bool)
                mark[np.frombuffer(row["hot"], np.uint32)] = True
                sig.append(s)
                ref.append(np.repeat(refs, counts))
                code.append(np.repeat(codes, counts))
                hot.append(mark)
        if sig:
            yield _member_batch(*_members(*map(np.concatenate, (sig, ref, code, hot)), bucket))

    return run


def _member_batch(g, code, ref) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(g), pa.array(code), pa.array(ref)], names=["g", "code", "ref"]
    )


def _task_vectors(scheme: Scheme):
    """(node, ref, text) -> (node, ref, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            sets = document_sets(batch.column(2), scheme.shingle)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "ref", "elements"],
            )

    return run


def _task_verify(percent: int):
    """(na, nb, ea, eb) -> (a, b) for the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], names=["a", "b"]
            ).filter(pa.array(keep, pa.bool_()))

    return run


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)

    def marks(sets: list[np.ndarray], flat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sets), len(both)), dtype=np.float32)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        known = both[at] == flat
        out[owner[known], at[known]] = 1
        return out

    if not len(both):
        return np.zeros((len(left), len(right)), dtype=np.int64)
    return (marks(left, a) @ marks(right, b).T).astype(np.int64)


def _task_blocks(percent: int):
    """(strays, members), each a list of (node, root, elements) -> linked nodes (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [batch.column(c)[row].values for c in (0, 1)]
                node = [np.array(x.field("node").to_pylist()) for x in sides]
                root = [np.array(x.field("root").to_pylist()) for x in sides]
                sets = [[np.frombuffer(e.as_buffer(), np.uint64) for e in x.field("elements")] for x in sides]
                size = [np.array([len(e) for e in x]) for x in sets]
                both = _overlaps(*sets)
                union = size[0][:, None] + size[1][None, :] - both
                i, j = np.nonzero(
                    (100 * both >= percent * union) & (root[0][:, None] != root[1][None, :])
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[0][i], pa.string()), pa.array(node[1][j], pa.string())], names=["a", "b"]
                )

    return run


# --- the join -----------------------------------------------------------------


def _linked(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """The pairs (of refs ``a, b``) that link, as nodes."""
    side = lambda x: vectors.select(
        F.col("ref").alias(x), F.col("node").alias("n" + x), F.col("elements").alias("e" + x)
    )
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("na", "nb", "ea", "eb").mapInArrow(_task_verify(percent), "a string, b string")


def _still_apart(cold: DataFrame, first: DataFrame, names: DataFrame) -> DataFrame:
    """Cold pairs in different components that were not compared."""
    side = lambda x: names.select(F.col("ref").alias(x), F.col("root").alias("r" + x))
    return (
        cold.select("a", "b").join(first, ["a", "b"], "left_anti")
        .join(side("a"), "a").join(side("b"), "b").filter("ra <> rb").select("a", "b")
    )


def _promising(members: DataFrame) -> DataFrame:
    """``g, code, ref, size``: members that share as many signatures as a partner
    would, in groups of two or more.

    A partner shares at least what the entry has to spare.
    """
    able = (
        members.groupBy("ref", "code").agg(F.count(F.lit(1)).alias("shared"))
        .filter(F.col("shared") >= F.shiftright("code", _SPARE_AT)).select("ref", "code")
    )
    # a hot signature's hub comes once from the task and once from the bucket
    left = materialise(
        members.join(materialise(able, "able"), ["ref", "code"]).select("g", "code", "ref").distinct(),
        "left",
    )
    sizes = left.groupBy("g").agg(
        F.count(F.lit(1)).alias("size"), F.min("ref").alias("lo"), F.max("ref").alias("hi")
    )
    return left.join(sizes.filter("lo <> hi").select("g", "size"), "g")


def _cold_pairs(members: DataFrame) -> DataFrame:
    """Pairs ``a < b`` that share enough signatures to be partners, and how many.

    Of signatures with at most HOT sets all are counted; of the others either
    side has ``spent`` some that might be shared too.
    """
    spent = (
        members.filter(F.col("size") > HOT)
        .groupBy("ref", "code").agg(F.count(F.lit(1)).alias("spent"))
    )
    cold = (
        members.filter(F.col("size") <= HOT).groupBy("g")
        .agg(F.array_sort(F.collect_set(F.struct("ref", "code"))).alias("m"))
        .select(F.explode("m").alias("x"), "m")
        .select("x", F.explode(F.filter("m", lambda y: y["ref"] > F.col("x.ref"))).alias("y"))
        .groupBy(F.col("x.ref").alias("a"), F.col("x.code").alias("ca"),
                 F.col("y.ref").alias("b"), F.col("y.code").alias("cb"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    side = lambda x: spent.select(
        F.col("ref").alias(x), F.col("code").alias("c" + x), F.col("spent").alias("s" + x)
    )
    least = F.greatest(F.shiftright("ca", _SPARE_AT), F.shiftright("cb", _SPARE_AT))
    more = F.least(F.coalesce("sa", F.lit(0)), F.coalesce("sb", F.lit(0)))
    return (
        cold.join(side("a"), ["a", "ca"], "left").join(side("b"), ["b", "cb"], "left")
        .filter(F.col("shared") + more >= least)
        .groupBy("a", "b").agg(F.max("shared").alias("shared"))
    )


def _first_pairs(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs most likely to link: each set with the one that shares most with it,
    and the members of hot signatures with their hub.

    The hub is the member with the most company over all its groups: of near
    copies, the one in the middle.
    """
    both = cold.unionByName(cold.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    best = both.groupBy("a").agg(F.max(F.struct("shared", "b"))["b"].alias("b"))
    company = hot.groupBy("ref").agg(F.sum("size").alias("company"))
    hubs = (
        hot.select("g", "ref").join(company, "ref")
        .groupBy("g").agg(F.max(F.struct("company", "ref"))["ref"].alias("hub"))
    )
    starred = hot.select("g", "ref").join(hubs, "g").filter("ref <> hub")
    return (
        best.unionByName(starred.select(F.col("ref").alias("a"), F.col("hub").alias("b")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _hot_links(hot: DataFrame, names: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that only hot signatures can show.

    A pair without a cold group shares as many hot ones as either has to spare:
    only sets with that many are left, and of their hot groups the smallest are
    enough, all but as many as they have to spare less one. Within these, sets
    outside their group's main component are compared with all others there, in
    blocks of about ``_BLOCK`` elements against blocks.
    """
    spare = F.greatest(F.shiftright("code", _SPARE_AT), F.lit(1))
    own = Window.partitionBy("ref", "code")
    few = (
        hot.withColumn("nth", F.row_number().over(own.orderBy("size", "g")))
        .withColumn("spent", F.count(F.lit(1)).over(own))
        .filter(F.col("nth") <= F.col("spent") - spare + 1)
    )
    few = few.join(names.select("ref", "root"), "ref").select("g", "ref", "root").distinct()
    torn = few.groupBy("g").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.mode("root", deterministic=True).alias("main"),
    )
    hot = few.join(torn.filter("lo <> hi").select("g", "main"), "g")
    sets = materialise(
        hot.select("main", "ref").distinct()
        .join(names.select("ref", "node", "root"), "ref")
        .join(vectors.select("node", "elements"), "node")
        .withColumn("n", F.octet_length("elements") / 8),
        "hot-sets",
    )

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        count = rows.groupBy("main").agg(F.ceil(F.sum("n") / _BLOCK).alias("blocks"))
        return (
            rows.join(count, "main")
            .groupBy("main", F.pmod(F.xxhash64("node"), F.col("blocks")).alias(f"{name}_block"))
            .agg(F.collect_list(F.struct("node", "root", "elements")).alias(name))
        )

    strays = materialise(blocks(sets.filter("root <> main"), "strays"), "strays")
    others = materialise(blocks(sets, "members"), "others")
    met = strays.join(others, "main").repartition("main", "strays_block", "members_block")
    return met.select("strays", "members").mapInArrow(_task_blocks(percent), "a string, b string")


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    scheme: Scheme = Scheme(),
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``th``, ``component``.

    ``component_id`` is the smallest id of the component; ``component`` names it
    also where ids are null (null for an empty set); ``th`` is xxhash64 of the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sets = materialise(
        source.mapInArrow(
            _task_sets(scheme), f"id {id_type}, th long, n long, d1 long, d2 long"
        ),
        "sets",
    )
    keyed = sets.withColumn("node", F.concat_ws(":", "n", "d1", "d2"))
    buckets = 2 * max(1, source.rdd.getNumPartitions())
    grouped = (
        source.select("text").mapInArrow(_task_signatures(scheme, buckets), _BLOB)
        .groupBy("bucket").applyInArrow(_task_groups(buckets), _MEMBER)
    )
    members = _promising(materialise(grouped, "members"))
    hot = materialise(members.filter(F.col("size") > HOT), "hot")
    cold = materialise(_cold_pairs(members), "cold")
    wanted = cold.select(F.explode(F.array("a", "b")).alias("ref")).unionByName(hot.select("ref"))
    # one document's text for each set that has candidates
    chosen = (
        keyed.filter("n > 0").groupBy("node", F.col("d1").alias("ref"))
        .agg(F.min(F.struct("id", "th")).alias("of"))
        .join(wanted.distinct(), "ref")
        .select("node", "ref", "of.id", "of.th")
    )
    chosen = materialise(chosen, "chosen")
    texts = (
        source.join(chosen.withColumnsRenamed({"id": "cid", "th": "cth"}),
                    F.col("th").eqNullSafe(F.col("cth")) & F.col("id").eqNullSafe(F.col("cid")))
        .select("node", "ref", "text").dropDuplicates(["node"])
    )
    vectors = materialise(
        texts.mapInArrow(_task_vectors(scheme), "node string, ref long, elements binary"),
        "vectors",
    )
    first = materialise(_first_pairs(cold, hot), "pairs")
    links = materialise(_linked(first, vectors, scheme.percent), "links")
    labels = components(links)
    names = vectors.select("ref", "node").join(labels, "node", "left")
    names = materialise(names.select("ref", "node", F.coalesce("root", "node").alias("root")), "names")
    left = materialise(_still_apart(cold, first, names), "pairs")
    more = materialise(
        _linked(left, vectors, scheme.percent)
        .unionByName(_hot_links(hot, names, vectors, scheme.percent)),
        "links",
    )
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    named = keyed.filter("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = materialise(
        named.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"),
        "named",
    )
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    per_node = named.join(lowest, "root").select("node", "root", "component_id")
    return keyed.join(per_node, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "th",
        F.col("root").alias("component"),
    )
