"""Connected components by randomised contraction.

Each round maps every node to the neighbour (or itself) of least seeded hash, which
is expected to remove a constant share of the nodes whatever the shape of the graph,
and keeps the edges between different images.  Rounds are written to the shared
folder; nothing is collected.  A node with very many neighbours is reduced on the
map side, and the joins are between a table and one that has each node once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every end of ``edges(u, v)``; nodes that reach each other share a label, which is one of them.

    Repeated edges, both directions and loops are allowed; nodes of loops alone do not appear.
    """
    rest = saved(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    maps, seed = [], 0
    while not rest.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("node"))
        both = rest.select(F.col("u").alias("node"), rank("v").alias("r")).unionByName(rest.select(F.col("v").alias("node"), rank("u").alias("r")))
        up = saved(both.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["node"].alias("up")), "up")
        maps.append(up)
        rest = saved(rest.join(up.toDF("u", "a"), "u").join(up.toDF("v", "b"), "v").where("a <> b")
                     .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        seed += 1
    if not maps:
        return rest.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = maps[0].select("node", F.col("up").alias("label"))
    for up in maps[1:]:
        labels = (labels.join(up.toDF("label", "up"), "label", "left")
                  .select("node", F.coalesce("up", "label").alias("label")))
    return saved(labels, "labels")


def union(parent, u, v):
    """Join the sets of ``u[i]`` and ``v[i]`` in a numpy parent array, whose roots are the least members; returns the array."""
    import numpy as np

    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        if len(u):
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return parent
