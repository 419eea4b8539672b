"""The trie of shared conversation prefixes, by van Emde Boas recursion.

A conversation is a sequence of turns (role, text). The trie of sequences of up to
2L turns is cut at depth L: prefixes of L turns get a name, those above the cut
make the upper trie, what follows each cut prefix makes the lower tries, and both
kinds are problems of half the depth. All problems of one size are solved
together, in one Spark job each, down to pieces of ``base`` turns, which one row
holds.

1. **Names.** Pieces of ``base`` turns are named by a SHA-256 of their turns, and
   aligned runs of 2, 4, 8 ... pieces by that of their halves. Then, from the whole
   depth down, every problem's upper half is added to the name of the prefix that
   the problem hangs on: that is the cut prefix, on which the lower problem hangs.
   After as many rounds as halvings each piece knows its prefix.
2. **Tries.** Equal pieces on equal prefixes become one, with the number of their
   conversations, before their nodes are laid out and joined by name.
3. **Grafts.** A node's own leaf and tokens count in one piece, the one of its
   smallest member; sums from the end of a piece give a node's total in its piece.
   Then, from the smallest problems up, the totals of a lower trie are added to
   its cut prefix's ancestors in the upper half, and at last to the nodes above
   each piece's end.

Names are SHA-256 of lengths and texts, so different prefixes are not taken for
one. A conversation may hold any share of all turns: turns are numbered in one
range sort (``ordering``), and no row or group holds more than ``base`` turns or
``_REACH`` pieces of one. A prefix may be shared by any share of all
conversations: members are counted before they meet, and ids of the members that
end at a node are strung together per range of ids; only the strings of one node
pass one hasher, in order, as a SHA-256 over them must.

Defined results: null role or text is empty; null turns come first; rows equal in
turn are ordered by the SHA-256 of length of role, role and text; rows without
conv_id belong to no conversation; an empty table has no node; other columns of
the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import ordering
from veilframe.sources.workdir import materialise

ROOT = "root"
WORD = r"[^\x20\x09-\x0D]+"
_REACH = 256  # pieces in one group of a graft
_SALTS = 256
_IDS = 1 << 10  # width of a range of ids that is strung together


def _sha(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def turns(rows: DataFrame) -> DataFrame:
    """(conv, at, digest, words): turns of each conversation in order, from 0."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    plain = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("spot"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("spot")]
    found = ordering.placed(ordering.in_order(plain, "conv", order, "words", "turns"), "conv", "words")
    return found.select("conv", F.col(ordering.NTH).alias("at"), "digest", "words")


def borrow_heads(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with another's first turns, as (sequences, conversations).

    Conversation c takes the first h turns of c - c % ``every``, h being a checksum
    of c modulo ``most``, before its own turns from the h-th on. ``rows`` are
    ``turns``.
    """
    conv = F.col("conv")
    h = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(most)).cast("long")
    base = conv - conv % F.lit(every)
    counted = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    every_conv = materialise(counted.select("conv", "length", h.alias("h"), base.alias("base")), "conversations")
    heads = rows.filter((F.col("at") < most - 1) & (base == conv)).select(
        conv.alias("base"), "at", "digest", "words"
    )
    taken = every_conv.select("conv", "base", "h").join(heads, "base").filter("at < h")
    lengths = every_conv.select(conv.alias("base"), F.col("length").alias("base_length"))
    shifts = (
        every_conv.join(lengths, "base", "left")
        .select("conv", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("got"), "length")
    )
    # a block of turns meets its conversation's shift, so that none is dealt out whole
    block = F.floor(F.col("at") / 1024).cast("long")
    shifts_by_block = shifts.filter("length > h").select(
        "conv", "h", "got", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / 1024).cast("long"))).alias("block")
    )
    own = (
        rows.withColumn("block", block)
        .join(shifts_by_block, ["conv", "block"])
        .filter("at >= h")
        .select("conv", (F.col("at") - F.col("h") + F.col("got")).alias("at"), "digest", "words")
    )
    return own.unionByName(taken.select("conv", "at", "digest", "words")), every_conv.select("conv")


# --- names ------------------------------------------------------------------


def _pieces(sequences: DataFrame, base: int) -> DataFrame:
    """(conv, blk, turns, name): pieces of up to ``base`` turns; ``name`` only of full ones."""
    cells = F.array_sort(F.collect_list(F.struct("at", "digest", "words")))
    pieces = (
        sequences.withColumn("blk", F.floor(F.col("at") / base).cast("long"))
        .groupBy("conv", "blk")
        .agg(cells.alias("cells"))
        .select(
            "conv", "blk",
            F.transform("cells", lambda c: F.struct(c["digest"].alias("digest"), c["words"].alias("words"))).alias("turns"),
        )
    )
    digests = F.array_join(F.transform("turns", lambda t: t["digest"]), "|")
    return pieces.withColumn("content", F.sha2(digests.cast("binary"), 256)).withColumn(
        "name", F.when(F.size("turns") == base, F.col("content"))
    )


def _runs(pieces: DataFrame, levels: int) -> list[DataFrame]:
    """Per level j the names of aligned full runs of 2^j pieces."""
    runs = [pieces.filter(F.col("name").isNotNull()).select("conv", "blk", "name")]
    for _ in range(1, levels):
        halves = F.array_sort(F.collect_list(F.struct("blk", "name")))
        pair = (
            runs[-1].groupBy("conv", F.floor(F.col("blk") / 2).cast("long").alias("up"))
            .agg(halves.alias("halves"))
            .filter(F.size("halves") == 2)
            .select(
                "conv", F.col("up").alias("blk"),
                _sha(F.col("halves")[0]["name"], F.col("halves")[1]["name"]).alias("name"),
            )
        )
        runs.append(materialise(pair, "runs"))
    return runs


def _hung(conversations: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """(conv, blk, start, end): the prefix that each piece hangs on, and that it leads to if full."""
    problems = conversations.select(
        "conv", F.lit(0).cast("long").alias("blk"), F.lit(ROOT).alias("start"), F.lit(None).cast("string").alias("end")
    )
    for names in reversed(runs):  # cut every problem at half its depth
        upper = names.select("conv", (F.col("blk") / 2).cast("long").alias("blk"), "name").filter(names["blk"] % 2 == 0)
        cut = F.when(F.col("name").isNotNull(), _sha(F.col("start"), F.col("name")))
        halved = problems.join(upper, ["conv", "blk"], "left").withColumn("cut", cut)
        above = F.struct((F.col("blk") * 2).alias("blk"), F.col("start"), F.col("cut").alias("end"))
        below = F.struct((F.col("blk") * 2 + 1).alias("blk"), F.col("cut").alias("start"), F.col("end"))
        both = F.when(F.col("cut").isNotNull(), F.array(above, below)).otherwise(F.array(above))
        problems = materialise(halved.select("conv", F.explode(both).alias("p")).select("conv", "p.*"), "cut")
    return problems


# --- tries ------------------------------------------------------------------


def _path(base: int) -> Column:
    """Names of the nodes of a piece: its prefix, then one turn more each; a full end is ``end``."""
    digests = F.transform("turns", lambda t: t["digest"])
    inner = F.transform(
        F.sequence(F.lit(1), F.least(F.size("turns"), F.lit(base - 1))),
        lambda i: _sha(F.col("start"), F.array_join(F.slice(digests, 1, i), "|")),
    )
    inner = F.when(F.least(F.size("turns"), F.lit(base - 1)) >= 1, inner).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array("start"), inner)


def _shared_pieces(hung: DataFrame, pieces: DataFrame, base: int) -> DataFrame:
    """One row per piece content and prefix: smallest conversation, their number, path."""
    both = hung.join(pieces.drop("name"), ["conv", "blk"], "left")
    none = F.array().cast("array<struct<digest:string,words:bigint>>")
    return (
        both.groupBy("blk", "start", F.coalesce("content", F.lit("")).alias("content"), "end")
        .agg(
            F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"),
            F.first("turns", ignorenulls=True).alias("turns"),  # equal in all of them
        )
        .withColumn("turns", F.coalesce("turns", none))
        .withColumn("path", _path(base))
    )


def _nodes(shared: DataFrame, base: int) -> DataFrame:
    """(name, depth, conv, n_convs, words, parent) of every node."""
    at = F.col("at").cast("long")
    laid = shared.select("*", F.posexplode("path").alias("at", "node"))
    inner = laid.select(
        F.col("node").alias("name"),
        (F.col("blk") * base + at).alias("depth"),
        "conv", "n",
        F.when(at > 0, F.try_element_at("turns", F.col("at"))["words"]).alias("words"),
        F.when(at > 0, F.try_element_at("path", F.col("at"))).alias("parent"),
    )
    # the last turn of a full piece is the root of the next: told here what it says
    borders = shared.filter(F.col("end").isNotNull()).select(
        F.col("end").alias("name"),
        ((F.col("blk") + 1) * base).alias("depth"),
        F.lit(None).cast("long").alias("conv"), F.lit(0).cast("long").alias("n"),
        F.element_at("turns", -1)["words"].alias("words"),
        F.element_at("path", -1).alias("parent"),
    )
    return (
        inner.unionByName(borders)
        .groupBy("name")
        .agg(
            F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n_convs"),
            F.coalesce(F.max("words"), F.lit(0)).alias("words"), F.max("parent").alias("parent"),
        )
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_conv_id and n_children; children of one parent are spread over salts."""
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(_SALTS)).cast("int"))
    families = materialise(
        salted.filter(F.col("parent").isNotNull()).groupBy("parent", "salt").agg(F.count(F.lit(1)).alias("n")), "families"
    )
    convs = nodes.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    told = families.select("parent", "salt").join(convs, "parent")
    children = families.groupBy(F.col("parent").alias("name")).agg(F.sum("n").alias("n_children"))
    return (
        salted.join(told, ["parent", "salt"], "left")
        .join(children, "name", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .drop("salt")
    )


# --- grafts -----------------------------------------------------------------

_SUMS = ("leaves", "saved")


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _valued(shared: DataFrame, nodes: DataFrame, base: int) -> DataFrame:
    """Pieces with what their own nodes add: per place along the path (leaf, saved tokens)."""
    own = F.struct(
        (F.col("depth") % base).alias("at"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    by_piece = nodes.groupBy("conv", F.floor(F.col("depth") / base).cast("long").alias("blk")).agg(
        F.collect_list(own).alias("own")  # at most ``base``
    )
    none = F.array().cast("array<struct<at:bigint,leaves:bigint,saved:bigint>>")
    return shared.join(by_piece, ["conv", "blk"], "left").withColumn("own", F.coalesce("own", none))


def _sum_from(at: Column | int, value: str) -> Column:
    """Sum of the piece's own values from a place on."""
    from_at = F.filter("own", lambda o: o["at"] >= at)
    return F.aggregate(from_at, F.lit(0).cast("long"), lambda acc, o: acc + o[value])


def _grafted(valued: DataFrame, hung: DataFrame, nodes: DataFrame, levels: int, base: int) -> DataFrame:
    """(start, leaves, saved): whole subtrees of the prefixes that pieces hang on."""
    totals = materialise(
        valued.groupBy("start", "blk").agg(*[F.sum(_sum_from(0, v)).alias(v) for v in _SUMS]), "totals"
    )
    if levels == 0:
        return totals.drop("blk")
    roots = nodes.filter(F.col("depth") % base == 0).select(F.col("name").alias("start"), "conv")
    paths = materialise(
        hung.filter(F.col("end").isNotNull()).select("conv", "blk", "start"), "paths"
    )
    with_conv = totals.join(roots, "start")
    for level in range(levels):
        reach = 1 << level
        cut = with_conv.filter((F.col("blk") % (2 * reach)) == reach)
        group = min(reach, _REACH)
        groups = F.sequence(
            F.floor((F.col("blk") - reach) / group).cast("long"), F.floor((F.col("blk") - 1) / group).cast("long")
        )
        sent = cut.select("conv", F.explode(groups).alias("group"), *_SUMS)
        above = paths.withColumn("group", F.floor(F.col("blk") / group).cast("long")).select("conv", "group", "start")
        # groups are no longer than a half and begin with one, so they hold the upper half alone
        added = above.join(sent, ["conv", "group"]).groupBy("start").agg(*[F.sum(v).alias(f"more_{v}") for v in _SUMS])
        with_conv = materialise(
            with_conv.join(added, "start", "left").select(
                "start", "blk", "conv", *[(F.col(v) + _zero(f"more_{v}")).alias(v) for v in _SUMS]
            ),
            "grafted",
        )
    return with_conv.select("start", *_SUMS)


def _subtrees(valued: DataFrame, grafted: DataFrame) -> DataFrame:
    """(name, n_leaves, saved_tokens) of every node."""
    below = grafted.select(F.col("start").alias("end"), *[F.col(v).alias(f"below_{v}") for v in _SUMS])
    # a full piece's end is one node's only way on: its subtree hangs on this piece alone
    with_below = valued.join(below, "end", "left")
    laid = with_below.select("*", F.posexplode("path").alias("at", "name"))
    return laid.groupBy("name").agg(
        *[F.sum(_sum_from(F.col("at"), v) + _zero(f"below_{v}")).alias(v) for v in _SUMS]
    ).select("name", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


# --- ends -------------------------------------------------------------------


def _hash_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node of strings that stream in by order."""
    names = ["name", "ends_sha256"]
    now, hasher = None, hashlib.sha256()
    for batch in batches:
        for name, text in zip(batch.column(0), batch.column(1), strict=True):
            name = name.as_py()
            if name != now:
                if now is not None:
                    yield pa.RecordBatch.from_pydict({names[0]: [now], names[1]: [hasher.hexdigest()]})
                now, hasher = name, hashlib.sha256()
            else:
                hasher.update(b",")
            hasher.update(text.as_py().encode())
    if now is not None:
        yield pa.RecordBatch.from_pydict({names[0]: [now], names[1]: [hasher.hexdigest()]})


def _ends(hung: DataFrame, pieces: DataFrame, base: int) -> DataFrame:
    """(name, ends_sha256): the conversations that end at each node, by id."""
    none = F.array().cast("array<struct<digest:string,words:bigint>>")
    last = (
        hung.filter(F.col("end").isNull())
        .join(pieces.select("conv", "blk", "turns"), ["conv", "blk"], "left")
        .withColumn("turns", F.coalesce("turns", none))
        .select("conv", F.element_at(_path(base), -1).alias("name"))
    )
    strung = materialise(
        last.groupBy("name", F.floor(F.col("conv") / _IDS).cast("long").alias("range"))
        .agg(F.array_sort(F.collect_list("conv")).alias("ids"))
        .select("name", "range", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("text")),
        "ends",
    )
    parts = strung.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.first("text").alias("text"))
    one = parts.filter("parts = 1").select("name", F.sha2(F.col("text").cast("binary"), 256).alias("ends_sha256"))
    several = (
        strung.join(parts.filter("parts > 1").select("name"), "name")
        .repartition("name")
        .sortWithinPartitions("name", "range")
        .select("name", "text")
        .mapInArrow(_hash_strings, "name string, ends_sha256 string")
    )
    return one.unionByName(several)


def trie(sequences: DataFrame, conversations: DataFrame, base: int = 8) -> DataFrame:
    """One row per node of the trie.

    ``sequences`` has (conv, at, digest, words), without gaps in ``at``;
    ``conversations`` every conv, also those without turns. Columns: conv_id,
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    sequences = materialise(sequences, "sequences")
    deepest = sequences.agg(F.max("at")).first()[0]
    # one more than the last turn: a conversation that ends at a border has an empty piece there
    n_pieces = 1 if deepest is None else (deepest + 1) // base + 1
    levels = (n_pieces - 1).bit_length()
    pieces = materialise(_pieces(sequences, base), "pieces")
    hung = _hung(conversations, _runs(pieces, levels) if levels else [])
    hung = materialise(hung, "hung")
    shared = materialise(_shared_pieces(hung, pieces, base), "shared")
    nodes = materialise(_with_parents(materialise(_nodes(shared, base), "nodes")), "families")
    valued = materialise(_valued(shared, nodes, base), "valued")
    subtrees = _subtrees(valued, _grafted(valued, hung, nodes, levels, base))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return (
        nodes.join(subtrees, "name")
        .join(_ends(hung, pieces, base), "name", "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children",
            "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )
