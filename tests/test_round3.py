"""What larger tables showed: the same results as before, without the step that grew."""

import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from braidline.operators import interval
from braidline.plans import registry

SF = "/root/testdata/sf0.001"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no data")


def test_grid_errors_are_the_single_ones():
    r = np.random.default_rng(3)
    for n in (2, 5, 40):
        x = np.sort(r.random(n) * 20)
        found = [(float(o), float(u)) for o, u in zip(r.random(60) * 3, r.random(60) + 0.1)]
        assert interval._grid_errors(x, found) == [interval.grid_error(x, o, u) for o, u in found]


@data
def test_fitted_grids_spread(spark):
    assert registry.QUERIES["fitted_grids"](spark, SF).rdd.getNumPartitions() > 4


def crowd(spark, n=60, wide=9):
    """Sets of which nearly all share tokens, so that they are compared by blocks."""
    r = np.random.default_rng(5)
    sets = {i: set(np.flatnonzero(r.random(wide) < 0.7).tolist()) for i in range(n)}
    return {i: s for i, s in sets.items() if s}, spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "pid long, token long")


def by_pairs(sets, value):
    return sorted((a, b, v) for a in sets for b in sets if a < b and sets[a] & sets[b] and (v := value(sets[a], sets[b])) is not None)


def test_crowded_sets_meet_by_blocks(spark, monkeypatch):
    from braidline.operators import blocks, patterns

    monkeypatch.setattr(blocks, "SETS", 16)  # several blocks
    monkeypatch.setattr(patterns, "counted", None)  # and no list of pairs by token
    sets, rows = crowd(spark)
    got = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    jaccard = lambda x, y: j if (j := round(len(x & y) / len(x | y), 6)) >= 0.7 else None
    dice = lambda x, y: d if (d := round(2 * len(x & y) / (len(x) + len(y)), 6)) >= 0.8 else None
    assert got(patterns.jaccard_pairs(rows, "pid", "token", 0.7)) == by_pairs(sets, jaccard)
    assert got(patterns.dice_pairs(rows, "pid", "token", 0.8)) == by_pairs(sets, dice)
    assert got(patterns.same_but_n(rows, "pid", "token", 2)) == by_pairs(sets, lambda x, y: len(x ^ y) if len(x ^ y) <= 2 else None)
    assert got(patterns.subset_pairs(rows, "pid", "token")) == sorted((a, b) for a in sets for b in sets if sets[a] < sets[b])


def test_version_similarity_counts_by_blocks(spark, monkeypatch):
    from collections import Counter

    from braidline.operators import blocks, patterns

    monkeypatch.setattr(blocks, "SETS", 16)
    members = [(p, v) for v in range(40) for p in range(6) if (v * 7 + p * 3) % 4] + [(0, 1), (0, 1), (5, 2)]
    links = [(0, 1), (1, 2), (1, 2), (2, 2)]
    want = Counter()
    for p, v in members:
        for q, w in members:
            if v < w and p == q:
                want[v, w] += 1
            if v != w:
                want[min(v, w), max(v, w)] += sum((p, q) == link for link in links)
    got = patterns.version_similarity(spark.createDataFrame(members, "pid long, version long"), spark.createDataFrame(links, "p long, q long"))
    assert {(r.a, r.b): r.n for r in got.collect()} == {k: n for k, n in want.items() if n}


def test_common_ends_by_blocks(spark, monkeypatch):
    from braidline.operators import blocks
    from braidline.operators.graph import Graph

    monkeypatch.setattr(blocks, "SETS", 8)
    edges = [(f"n{a}", f"n{b}") for a in range(30) for b in range(30) if (a * 5 + b * 3) % 4 == 0]
    nodes = sorted({x for e in edges for x in e})
    out, into = ({n: {e[1 - k] for e in edges if e[k] == n} for n in nodes} for k in (0, 1))
    want = sorted((a, b) for a in nodes for b in nodes if out[a] & out[b] or into[a] & into[b])
    g = Graph(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in edges], "eid string, src string, dst string"))
    found = g.neighbours()
    assert sorted(map(tuple, found.collect())) == want
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().toString()


def test_classes_are_the_graph_of_their_edges(spark):
    from braidline.operators import graph_local, partition
    from braidline.operators.classes import Classes
    from braidline.operators.graph import Graph

    r = np.random.default_rng(7)
    rows = [(f"{v}.{t}", v if v != 9 else None, t, None if r.random() < 0.1 else "abc"[r.integers(3)], None if r.random() < 0.1 else int(r.integers(4))) for v in range(14) for t in range(5)]
    nodes = spark.createDataFrame(rows, "id string, version long, time long, symbol string, slice long").cache()
    pairs = [(a[0], b[0]) for a in rows for b in rows if None not in (a[1], b[1], a[3]) and a[1] < b[1] and a[2:4] == b[2:4]]
    g = Graph(nodes, spark.createDataFrame([(f"{a}-{b}", a, b) for a, b in pairs], "eid string, src string, dst string").cache())
    c = Classes(("time", "symbol"), "version")
    rows_of = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows_of(c.degrees(nodes)) == rows_of(g.degrees())
    assert rows_of(c.isolated(nodes).select("id")) == rows_of(g.isolated().select("id"))
    assert rows_of(c.components(nodes)) == rows_of(g.components())
    assert rows_of(c.members(nodes)) == rows_of(graph_local.maximal_cliques(g))
    assert rows_of(c.cover(nodes)) == rows_of(graph_local.graph_cover(g))
    assert rows_of(c.edges(nodes.where("slice < 2"))) == rows_of(g.subgraph(nodes.where("slice < 2").select("id")).edges.select("src", "dst"))
    p, at = nodes.withColumnRenamed("id", "node_id").withColumn("one", F.lit(1)), Classes(c.by, "version", "node_id")
    for f in (partition.connection_matrix, partition.affinity_outliers, lambda e, p: partition.inter_slice_edges(e, p, 1, 3).select("src", "dst"),
              lambda e, p: partition.linked_nodes(e, p, ["one"]), lambda e, p: partition.largest_components(e, p, ["one"]), lambda e, p: partition.constrain(e, p, ["one"], size_factor=3.0)):
        assert rows_of(f(at, p)) == rows_of(f(g.edges, p).select(*f(at, p).columns))


@data
def test_segment_queries_list_no_edges(spark):
    for q in ("connected_components", "maximal_cliques", "graph_cover", "connection_matrix", "graph_degree", "isolated_nodes"):
        assert "SortMergeJoin" not in (plan := registry.QUERIES[q](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) and "Join" not in plan


def test_nearest_rows_are_those_of_all_pairs(spark, monkeypatch):
    from braidline.operators import classify

    monkeypatch.setattr(classify, "ROWS", 16)  # several parts
    monkeypatch.setattr(classify, "QUERIES", 4)
    r = np.random.default_rng(11)
    rows = [(i, i % 3, [float(x) for x in r.integers(0, 3, 5)]) for i in range(70)] + [(70, 0, None)]
    v = spark.createDataFrame(rows, "id long, label int, v array<double>").cache()
    q, whole = v.where("id % 5 = 0"), v.where("v IS NOT NULL")
    pairs = classify.pair_distances(whole, q.where("v IS NOT NULL"))
    want = {}
    for p in pairs.collect():
        want.setdefault(p.a, []).append((p.d, p.b))
    got = {}
    for p in classify.nearest_rows(v, q, 4).collect():
        got.setdefault(p.a, []).append((p.d, p.b))
    assert {a: sorted(x)[:4] for a, x in got.items()} == {a: sorted(x)[:4] for a, x in want.items()}
    sums = {x.id: (round(x.total, 9), x.nearest, x.farthest) for x in classify.distance_sums(v, q).collect()}
    assert sums == {a: (round(sum(d for d, _ in x), 9), min(x)[1], min((-d, b) for d, b in x)[1]) for a, x in want.items()}


@data
def test_multiples_are_listed_in_stretches(spark, monkeypatch):
    from braidline.plans import graphs

    monkeypatch.setattr(graphs, "_STRETCH", 7)
    n = [r.p_partkey for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey").collect()]
    assert sorted((r.src, r.dst) for r in graphs._divisors(spark, SF).edges.collect()) == sorted((a, b) for a in n if a for b in n if b > a and b % a == 0)


@data
def test_coverage_has_no_window_of_all_segments(spark):
    from braidline.operators import interval

    truth = spark.createDataFrame([(0, i, 4 * i, 4 * i + 2) for i in range(9)], "gt long, seg long, s0 long, s1 long")
    found = spark.createDataFrame([(p, i, 4 * i + p, 4 * i + p + 1) for p in (0, 1) for i in range(0, 9, 2)], "pattern long, occ long, o0 long, o1 long")
    out = interval.coverage(found, truth)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.pattern, round(r.coverage, 6)) for r in out.collect()) == [(0, round(5 * 2 / 3 / 9, 6)), (1, round(5 * 2 / 3 / 9, 6))]


def test_groups_count_their_edges_by_triangles(spark):
    from braidline.operators.graph import Graph

    r = np.random.default_rng(13)
    edges = [(str(i), f"n{a}", f"n{b}") for i, (a, b) in enumerate(r.integers(0, 12, (50, 2)).tolist())]
    edges += [("x", "n1", "n2"), ("y", "n2", "n1"), ("z", "n3", "n3")]
    g = Graph(spark.createDataFrame([(f"n{i}",) for i in range(13)], "id string"), spark.createDataFrame(edges, "eid string, src string, dst string"))
    got = {x.center: (x.members, x.value, x.internal) for x in g.groups().collect()}
    for n in (f"n{i}" for i in range(13)):
        members = {n} | {b for _, a, b in edges if a == n} | {a for _, a, b in edges if b == n}
        assert got[n] == (sorted(members), len(members), sum(a in members and b in members for _, a, b in edges))


def test_classes_of_a_piece_meet_without_another_exchange(spark):
    from braidline.operators import align

    r = np.random.default_rng(17)
    points = spark.createDataFrame([(k, int(t), int(y)) for k in range(6) for t, y in r.integers(0, 5, (9, 2))], "song long, t long, y long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = align._classes(points, "song", 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(song" in plan and "hashpartitioning(song#" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "pattern" in x]


def test_optics_holds_no_pairs():
    import tracemalloc

    from braidline.operators import classify

    x = np.random.default_rng(19).random((1500, 5))
    tracemalloc.start()
    found = classify.optics_order(x, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1500 and peak < 1500 * 1500 * 8
