"""Connected components of an edge table, by hooking to smaller neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise


def connected_components(edges: DataFrame, *, src: str = "src", dst: str = "dst", most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) of every node with an edge.

    Each round keeps every node's smallest smaller neighbour as its parent, links the
    parent with its other smaller neighbours, and replaces a parent by that parent's
    own; stars remain. Self loops and null ends are dropped; a node with nothing but a
    self loop is its own component. Minimums are partly aggregated before they are
    exchanged, and rounds grow with the log of the longest path.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = ends.where(F.col("a") == F.col("b")).select("a").distinct()
    links = ends.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialise(links, "components")
    for _ in range(most_rounds):
        parent = links.groupBy("a").agg(F.min("b").alias("p"))
        others = links.join(parent, "a").where(F.col("b") != F.col("p"))
        others = others.select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(True).alias("moved"))
        kept = parent.select("a", F.col("p").alias("b"), F.lit(False).alias("moved")).unionByName(others)
        up = parent.select(F.col("a").alias("b"), F.col("p").alias("up"))
        kept = kept.join(up, "b", "left").select("a", F.coalesce("up", "b").alias("b"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        kept = materialise(kept.where(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max("moved").alias("moved")), "components")
        links = kept.select("a", "b")
        if kept.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.join(links, loops.a == links.a, "left_anti").join(roots, loops.a == roots.node, "left_anti")
    return found.unionByName(roots).unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("component")))
