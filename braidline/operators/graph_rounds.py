"""Spanning forests, bridges and ears by rounds of joins: no component meets in one task.

The graph counts as undirected and simple. All rounds go by the level of a breadth first
forest, so their number follows the forest's depth; each is written, and holds one row a
node of a level or an edge outside the forest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .graph import Graph


def simple_edges(graph: Graph) -> DataFrame:
    """src < dst: every pair of different nodes with an edge, once."""
    e = graph.edges.where("src <> dst")
    return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other")))


def _simple(graph: Graph) -> Graph:
    """The graph with its ``simple_edges``, written once: all rounds read them."""
    return Graph(materialise(graph.nodes.select("id"), "forest-nodes"), materialise(simple_edges(graph), "forest-edges"))


def _levels(graph: Graph) -> list[DataFrame]:
    """parent, id, depth of each level of a ``_simple`` graph: roots are the smallest nodes
    of the components, and a node's parent is the smallest of the level above it has an edge
    to."""
    step = _both(graph.edges)
    roots = graph.components().where("id = component").select("id")
    front = materialise(roots.select(F.lit(None).cast(graph.nodes.schema["id"].dataType).alias("parent"), "id", F.lit(0).alias("depth")), "forest")
    out = [front]
    while True:
        found = front.select("id").join(step, "id").groupBy(F.col("other").alias("id")).agg(F.min("id").alias("parent"))
        # neighbours of a level are in it, above it, or new
        seen = reduce(DataFrame.unionByName, [d.select("id") for d in out[-2:]])
        front = materialise(found.join(seen, "id", "left_anti").select("parent", "id", F.lit(len(out)).alias("depth")), "forest")
        if not front.limit(1).count():
            return out
        out.append(front)


def spanning_forest(graph: Graph) -> DataFrame:
    """parent, id, depth of a breadth first forest; roots have no parent."""
    return reduce(DataFrame.unionByName, _levels(_simple(graph)))


def _meeting_depths(edges: DataFrame, forest: DataFrame) -> DataFrame:
    """src, dst, meet: the depth at which the ways up from both ends of an edge meet. Edges
    outside a breadth first forest join nodes of one level or of two that follow."""
    up = forest.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("depth").alias("_depth"))
    at = lambda df, end: df.join(up, F.col(end) == F.col("_id")).drop("_id")
    both = at(edges, "src").select("src", "dst", F.col("_parent").alias("pa"), F.col("_depth").alias("da"))
    both = at(both, "dst").select("src", "dst", "pa", "da", F.col("_parent").alias("pb"), F.col("_depth").alias("db"))
    level = F.least("da", "db")
    a, b = F.when(F.col("da") > level, F.col("pa")).otherwise(F.col("src")), F.when(F.col("db") > level, F.col("pb")).otherwise(F.col("dst"))
    going, done = materialise(both.select("src", "dst", a.alias("a"), b.alias("b"), level.alias("level")), "meeting"), []
    while True:
        done.append(going.where("a = b").select("src", "dst", F.col("level").alias("meet")))
        apart = going.where("a <> b")
        if not apart.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        step = at(apart, "a").select("src", "dst", F.col("_parent").alias("a"), "b", "level")
        step = at(step, "b").select("src", "dst", "a", F.col("_parent").alias("b"), (F.col("level") - 1).alias("level"))
        going = materialise(step, "meeting")


def _covers(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """Of every edge (parent, id) of the forest, the edge outside it whose circle contains
    it and reaches highest, ties to the smallest (null: none, so a bridge); and the edges
    outside. An edge with an end below ``id`` leads out of the part below ``id`` just if its
    ends meet higher up, so the least of all below tells."""
    graph = _simple(graph)
    levels = _levels(graph)
    forest = materialise(reduce(DataFrame.unionByName, levels), "forest")
    tree = forest.where("parent IS NOT NULL").select(F.least("parent", "id").alias("src"), F.greatest("parent", "id").alias("dst"))
    outside = materialise(graph.edges.join(tree, ["src", "dst"], "left_anti"), "outside")
    reach = F.struct("meet", F.col("src").alias("by_src"), F.col("dst").alias("by_dst")).alias("reach")
    met = _meeting_depths(outside, forest)
    own = materialise(met.select(F.explode(F.array("src", "dst")).alias("id"), reach).groupBy("id").agg(F.min("reach").alias("reach")), "reach")
    below, out = None, []
    for level in reversed(levels[1:]):
        lows = own.join(level.select("id"), "id", "left_semi")
        lows = lows if below is None else lows.unionByName(below.where("reach IS NOT NULL").select(F.col("parent").alias("id"), "reach"))
        low = level.join(lows.groupBy("id").agg(F.min("reach").alias("reach")), "id", "left")
        below = materialise(low, "reach")
        out.append(below)
    if not out:
        return levels[0].limit(0).select("parent", "id", *[F.lit(None).cast(graph.nodes.schema["id"].dataType).alias(c) for c in ("by_src", "by_dst")]), outside
    every = reduce(DataFrame.unionByName, out)
    leads_out = F.coalesce(F.col("reach.meet") < F.col("depth"), F.lit(False))
    return every.select("parent", "id", *[F.when(leads_out, F.col(f"reach.{c}")).alias(c) for c in ("by_src", "by_dst")]), outside


def bridges(graph: Graph) -> DataFrame:
    """src, dst: edges in no circle of the undirected simple graph."""
    covers, _ = _covers(graph)
    return covers.where("by_src IS NULL").select(F.least("parent", "id").alias("src"), F.greatest("parent", "id").alias("dst"))


def ear_chains(graph: Graph) -> DataFrame:
    """by_src, by_dst, src, dst: every edge that is no bridge, with the edge outside the
    forest that closes its ear. An ear is a path through its closing edge; the edges of
    ears that reach higher are not in it again."""
    covers, outside = _covers(graph)
    own = outside.select(F.col("src").alias("by_src"), F.col("dst").alias("by_dst"), "src", "dst")
    held = covers.where("by_src IS NOT NULL").select("by_src", "by_dst", F.least("parent", "id").alias("src"), F.greatest("parent", "id").alias("dst"))
    return own.unionByName(held)


def not_in_cycles(graph: Graph) -> DataFrame:
    """Nodes all of whose edges are bridges, and isolated ones."""
    ears = ear_chains(graph).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.nodes.select("id").join(ears, "id", "left_anti")
