"""Connected components of an edge table, by contraction.

In each round every node goes to whichever of its neighbours and itself has the
smallest hash for that round, and edges are rewritten to where their ends went.
A star falls into its centre in one or two rounds and a path loses a constant
part per round, so rounds grow with the logarithm of the nodes. Nothing but a
test for "no edges left" reaches the driver; each round is written to the shared
folder. A hub's edges meet only in partial minima and in joins with one row per
node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.sources.workdir import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``)."""
    left = materialise(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = left.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    turn = 0
    while not left.isEmpty():
        turn += 1
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c, t=turn: F.struct(F.xxhash64(F.lit(t), c).alias("h"), c.alias("n"))
        to = materialise(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(ranked(F.col("b"))).alias("best"), F.min(ranked(F.col("a"))).alias("own"))
            .select("node", F.least("best", "own")["n"].alias("root")),
            "hooks",
        )
        if turn == 1:  # every node has an edge
            labels = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = materialise(
                labels.join(step, "root", "left").select(
                    "node", F.coalesce("next", "root").alias("root")
                ),
                "labels",
            )
        a = to.withColumnsRenamed({"node": "a", "root": "ra"})
        b = to.withColumnsRenamed({"node": "b", "root": "rb"})
        left = materialise(
            left.join(a, "a").join(b, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct(),
            "edges",
        )
    return labels
