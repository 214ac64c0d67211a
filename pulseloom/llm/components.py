"""Connected components of an edge table, by hooking, pointer jumping and contraction.

Each round, every node hooks onto its smallest neighbour (a group-by, combined in each task), pointers
jump to the roots of the trees that arise, and the edges are contracted to edges between roots: what
is connected by then is gone from the table, so later rounds are small. All state is DataFrames (one row a
node, one row an edge), materialised in the shared checkpoint folder; only one number a step comes to
the driver. At least half of the nodes that have edges go in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import cut


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) of (node, root) pointers to nodes of the same table, none to a larger one."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut(parents.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v): component is the smallest node reachable.

    Loops and repeated edges don't matter; nodes without edges are not in the result."""
    found = None
    # Cut before it is read twice: edges that are worked out anew may be others that connect the same.
    pairs = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    while True:
        both = pairs.union(pairs.select("v", "u"))
        roots = _roots(cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("root"))))
        if found is None:
            found = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = cut(found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        ends = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))  # noqa: B023, E731
        left = pairs.join(ends("u"), "u").join(ends("v"), "v").where("root_u <> root_v")
        pairs = cut(left.select(F.least("root_u", "root_v").alias("u"), F.greatest("root_u", "root_v").alias("v")).distinct())
        if pairs.isEmpty():
            return found.withColumnRenamed("root", "component")
