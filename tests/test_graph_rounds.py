"""Forests, bridges and ears by rounds against plain versions, on random graphs."""

import random

from pyspark.sql import functions as F

from braidline.operators import graph_local, graph_rounds
from braidline.operators.graph import Graph


def made(spark, pairs, nodes):
    return Graph.of(
        spark.createDataFrame([(n,) for n in nodes], "id string"),
        spark.createDataFrame([(f"{i}", a, b) for i, (a, b) in enumerate(pairs)], "eid string, src string, dst string"),
    )


def some_pairs():
    """Trees, circles and cliques, joined here and there; loops and repeated edges too."""
    pairs, nodes = [], []
    for part in "abcdef":
        rnd = random.Random(part)
        n = 12
        own = [(i, rnd.randrange(max(i - 5, 0), i)) for i in range(1, n) if i % 9]
        own += [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 6))]
        pairs += [(f"{part}{a:02}", f"{part}{b:02}") for a, b in [*own, own[0], own[0][::-1], (3, 3)]]
        nodes += [f"{part}{i:02}" for i in range(n + 1)]
    return pairs, nodes


def near_of(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def test_rounds(spark):
    pairs, nodes = some_pairs()
    g, near = made(spark, pairs, nodes), near_of(pairs)
    alone = [(None, n, 0) for n in nodes if n not in near]
    forest = list(map(tuple, graph_rounds.spanning_forest(g).collect()))
    assert sorted(forest, key=repr) == sorted(graph_local.forest_of(near) + alone, key=repr)
    bridges = sorted(map(tuple, graph_rounds.bridges(g).collect()))
    assert bridges == sorted(graph_local.bridge_pairs(near))
    ears = {}
    for r in graph_rounds.ear_chains(g).collect():
        ears.setdefault((r.by_src, r.by_dst), set()).add((r.src, r.dst))
    simple = {tuple(sorted(p)) for p in pairs if p[0] != p[1]}
    assert sorted(e for ear in ears.values() for e in ear) == sorted(simple - set(bridges))
    tree = {tuple(sorted((p, n))) for p, n, _ in forest if p}
    assert set(ears) == simple - tree
    for by, edges in ears.items():  # a path through its closing edge, or a circle
        ends = near_of(edges)
        assert by in edges and all(len(x) <= 2 for x in ends.values()) and len(edges) >= len(ends) - 1
        front, seen = [by[0]], set()
        while front:
            v = front.pop()
            if v not in seen:
                seen.add(v)
                front += ends[v]
        assert seen == set(ends)
    left = sorted(n for n in nodes if not any(n in e for e in simple - set(bridges)))
    assert sorted(r.id for r in graph_rounds.not_in_cycles(g).collect()) == left


def test_no_edges(spark):
    g = made(spark, [("a", "a")], ["a", "b"])
    assert graph_rounds.bridges(g).count() == graph_rounds.ear_chains(g).count() == 0
    assert sorted(map(tuple, graph_rounds.spanning_forest(g).collect()), key=repr) == [(None, "a", 0), (None, "b", 0)]
    assert graph_rounds.not_in_cycles(g).count() == 2


def test_edges_are_made_once(spark):
    """Rounds read the edges where they were written, and do not make them anew."""
    made = spark.sparkContext.accumulator(0)

    def edges(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    ends = [(1, 2), (2, 3), (3, 4), (4, 5), (3, 5), (6, 7)]
    e = spark.createDataFrame(ends, "src long, dst long").coalesce(1).mapInArrow(edges, "src long, dst long")
    g = Graph(spark.range(1, 8), e.withColumn("eid", F.concat_ws("-", "src", "dst")))
    for run in (lambda: graph_rounds.bridges(g), lambda: graph_rounds.spanning_forest(g)):
        before = made.value
        run().collect()
        assert made.value - before == len(ends)
    before = made.value
    assert {r.id: r.distance for r in g.distances(spark.range(1, 2)).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 3}
    assert made.value - before == 2 * len(ends)  # once in either direction
