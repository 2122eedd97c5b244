"""Graph algorithms that are sequential within a component: one task a component."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph
from .graph_rounds import bridges, not_in_cycles, spanning_forest  # noqa: F401


def _by_component(graph: Graph, run, schema: str) -> DataFrame:
    c = graph.components()
    e = graph.edges.select("src", "dst").distinct().where("src <> dst").join(c.withColumnRenamed("id", "src"), "src")
    return e.groupBy("component").applyInPandas(run, schema)


def _alone(graph: Graph) -> DataFrame:
    """id of the nodes that no edge joins to another."""
    ends = graph.edges.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.nodes.select("id").distinct().join(ends, "id", "left_anti")


def _neighbours(pdf) -> dict:
    near: dict = {}
    for a, b in zip(pdf.src, pdf.dst):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def bridge_pairs(near: dict) -> list[tuple]:
    """Pairs whose removal parts the graph: depth first with low links, no recursion."""
    order, low, out = {}, {}, []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, v, iter(sorted(near[w]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > order[parent]:
                        out.append(tuple(sorted((parent, v))))
    return out


def cliques_of(near: dict) -> list[list]:
    """Maximal cliques, with pivots and an explicit stack."""
    out, stack = [], [((), set(near), set())]
    while stack:
        clique, some, done = stack.pop()
        if not some and not done:
            out.append(sorted(clique))
            continue
        if not some:
            continue
        pivot = max(sorted(some | done), key=lambda v: len(near[v] & some))
        for v in sorted(some - near[pivot]):
            stack.append(((*clique, v), some & near[v], done & near[v]))
            some, done = some - {v}, done | {v}
    return out


def maximal_cliques(graph: Graph) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"members": cliques_of(_neighbours(pdf))})

    return _by_component(graph, run, "members array<string>").unionByName(_alone(graph).select(F.array("id").alias("members")))


def forest_of(near: dict) -> list[tuple]:
    """parent, node, depth of a breadth first forest; roots have no parent, and others the
    smallest one of the level above."""
    seen, out = {}, []
    for root in sorted(near):
        level = [] if root in seen else [(None, root)]
        depth = 0
        while level:
            seen.update({v: depth for _, v in level})
            out += [(p, v, depth) for p, v in level]
            new = {w for _, v in level for w in near[v] if w not in seen}
            own = {v for _, v in level}
            level = [(min(near[w] & own), w) for w in sorted(new)]
            depth += 1
    return out


def preorder_of(children: dict, root) -> list:
    """Nodes below ``root``, each before its children, these in order."""
    out, stack = [], [root]
    while stack:
        v = stack.pop()
        out.append(v)
        stack += sorted(children.get(v, ()), reverse=True)
    return out


def preorder(graph: Graph) -> DataFrame:
    """root, id, place in a forest of directed edges; a node whose component is no tree
    (a node with two parents, or a cycle) is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        below, nodes = {}, set(pdf.src) | set(pdf.dst)
        for a, b in zip(pdf.src, pdf.dst):
            below.setdefault(a, []).append(b)
        roots = sorted(nodes - set(pdf.dst))
        tree = len(roots) == 1 and len(pdf) == len(nodes) - 1
        rows = [(roots[0], v, i) for i, v in enumerate(preorder_of(below, roots[0]))] if tree else []
        return pd.DataFrame(rows, columns=["root", "id", "place"])

    alone = _alone(graph).select(F.col("id").alias("root"), "id", F.lit(0).cast("long").alias("place"))
    return _by_component(graph, run, "root string, id string, place long").unionByName(alone)


def cover_of(near: dict) -> list[tuple]:
    """center, members: the group (a node and neighbours) with most members not yet
    covered, again and again; ties to the smaller center."""
    left, out = set(near), []
    while left:
        center = min(near, key=lambda v: (-len(({v} | near[v]) & left), v))
        got = ({center} | near[center]) & left
        out.append((center, sorted(got)))
        left -= got
    return out


def graph_cover(graph: Graph) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cover_of(_neighbours(pdf)), columns=["center", "members"])

    alone = _alone(graph).select(F.col("id").alias("center"), F.array("id").alias("members"))
    return _by_component(graph, run, "center string, members array<string>").unionByName(alone)


def chains_of(near: dict) -> list[list]:
    """Chain decomposition: from each back edge along the tree to a visited node."""
    parent, order = {}, {}
    for root in sorted(near):
        if root in order:
            continue
        parent[root] = None
        order[root] = len(order)
        stack = [(root, iter(sorted(near[root])))]
        while stack:
            v, rest = stack[-1]
            w = next((w for w in rest if w not in order), None)
            if w is None:
                stack.pop()
            else:
                parent[w], order[w] = v, len(order)
                stack.append((w, iter(sorted(near[w]))))
    seen, chains = set(), []
    for v in sorted(order, key=order.get):
        for w in sorted(near[v], key=order.get):
            if order[w] > order[v] and parent[w] != v:
                seen.add(v)
                chain, at = [v, w], w
                while at not in seen:
                    seen.add(at)
                    at = parent[at]
                    chain.append(at)
                chains.append(chain)
    return chains
