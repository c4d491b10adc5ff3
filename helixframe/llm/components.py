"""Connected components of an edge table by contraction with pointer jumping, all of it as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, root), saved, for every node of ``edges`` (u long, v long, undirected); root is the component's smallest node.

    A round hangs each node under the smallest of its neighbours and itself, which gives trees; then
    every node jumps to the parent of its parent until all stand under their tree's root, so a chain of
    n nodes takes log2(n) jumps. The trees become the nodes of the next round, and edges within a tree
    go. A root that no node hangs under has a neighbour in the tree of a smaller root, under which it
    hangs in the next round: so trees halve at least every other round, and rounds grow with the
    logarithm of the nodes. The smallest node of a component always stays a root.

    Each step is saved to the shared folder and the one before it deleted, so plans do not grow. Rows
    of a hub meet in min() aggregates, combined before the shuffle, and in salted joins.
    """
    edges = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    labels = None
    while labels is None or not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = saved(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("root")), "step")
        moved = True
        while moved:
            up = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = saved(spread_join(step, up, ["root"]).select("node", F.col("next").alias("root"), (F.col("next") < F.col("root")).alias("moved")), "step")
            moved = not jumped.where("moved").isEmpty()
            forget(step)
            step = jumped
        to = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        before, left = labels, edges
        labels = step.select("node", "root") if before is None else saved(spread_join(before, to, ["root"], "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        inside = spread_join(edges, to.toDF("u", "ru"), ["u"])
        inside = spread_join(inside, to.toDF("v", "rv"), ["v"]).where("ru <> rv")
        edges = saved(inside.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if before is not None:
            forget(before, step)
        forget(left)
    forget(edges)
    return labels
