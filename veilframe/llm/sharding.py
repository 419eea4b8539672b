"""Sharding by a weighted hash tree: region, then rack, then shard.

At every level each child draws from the document's id: the logarithm of a hash
taken as a number between 0 and 1, over the child's weight; the largest draw
wins. A child's draws depend on nothing but the id and the child, so when
weights change, only documents for which a changed child's draw now wins or no
longer wins move, and only at the level and in the subtree that changed. A shard
added as a region of its own therefore only receives. Law ``key``: the id and
the tree decide, nothing else.

Slots number each shard's documents without gaps in hash order. They come from
counts per shard and hash cell, so no task holds a shard.

Defined results: null and repeated ids go where their id goes (all null ids to
one shard); null text has no bytes and a null checksum; an empty table gives an
empty table; columns of the input stay, and names this module adds replace equal
ones.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import layout

_DIGITS = 13  # hex digits of the hash: 52 bits, exact in a double


@dataclass(frozen=True)
class Node:
    """A region, a rack, or (with ``shard``) a shard; weights of leaves add up."""

    name: str
    children: tuple["Node", ...] = field(default=())
    shard: int | None = None
    own: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own


def tree(shape: Mapping[str, Mapping[str, Mapping[int, float]]]) -> Node:
    """``{region: {rack: {shard: weight}}}`` as a tree."""
    return Node(
        "root",
        tuple(
            Node(
                region,
                tuple(
                    Node(
                        f"{region}/{rack}",
                        tuple(
                            Node(f"{region}/{rack}/{s}", shard=s, own=float(w))
                            for s, w in shards.items()
                        ),
                    )
                    for rack, shards in racks.items()
                ),
            )
            for region, racks in shape.items()
        ),
    )


#: Two regions of two racks of two equal shards, and the same with one more.
EIGHT = {
    "north": {"a": {0: 1.0, 1: 1.0}, "b": {2: 1.0, 3: 1.0}},
    "south": {"a": {4: 1.0, 5: 1.0}, "b": {6: 1.0, 7: 1.0}},
}
NINE = {**EIGHT, "east": {"a": {8: 1.0}}}


def _draw(key: Column, node: Node) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit("|" + node.name))), 1, _DIGITS)
    number = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return F.log(number) / F.lit(node.weight)


def place(key: Column, node: Node) -> Column:
    """The shard that a key reaches from ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    open_ = [c for c in node.children if c.weight > 0]
    if not open_:
        raise ValueError(f"nothing below {node.name} has weight")
    if len(open_) == 1:
        return place(key, open_[0])
    best = F.greatest(*[F.struct(_draw(key, c), F.lit(i)) for i, c in enumerate(open_)])["col2"]
    out = place(key, open_[-1])
    for i, child in enumerate(open_[:-1]):
        out = F.when(best == i, place(key, child)).otherwise(out)
    return out


def shard(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shape: Mapping = EIGHT,
    grown: Mapping | None = NINE,
    seed: str = "shard",
) -> DataFrame:
    """Each row with ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    text = F.col(text_col)
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = (
        docs.withColumn("__key", key)
        .withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long"))
        .withColumn("text_crc32", F.crc32(text.cast("binary")))
        .withColumn("law", F.lit("key"))
        .withColumn("shard", place(F.col("__key"), tree(shape)).cast("int"))
        .withColumn(
            "grown_shard",
            place(F.col("__key"), tree(grown)).cast("int") if grown else F.lit(None).cast("int"),
        )
        .withColumn("__hash", layout.order_hash(seed + "-slot", F.col(id_col), text))
        .withColumn("__one", F.lit(1).cast("long"))
    )
    rows = layout.with_cells(rows, "__hash").drop("slot")
    offsets = layout.cell_offsets(layout.cell_totals(rows, ["shard"], "__one"), ["shard"])
    return (
        rows.join(offsets, ["shard", layout.CELL])
        .withColumn("slot", layout.sum_before(["shard"], ["__hash", "size", "text_crc32"], "__one"))
        .drop("__key", "__hash", "__one", "__offset", layout.CELL)
    )
