"""Queries over whole tables, against brute force on small fixtures."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from braidline.plans import registry


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def run(name, spark, folder):
    return sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).collect())


def test_bidirectional_edges(spark, tmp_path):
    # the reverse of (1, 2) stands only in an order whose key 7 does not divide
    rows = [(7, 2, 1, 50.0), (8, 1, 2, 50.0), (14, 4, 3, 50.0), (21, 3, 4, 1.0), (7, 6, 5, 50.0)]
    sf = put(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double"))
    pairs = {(s, p) for _, p, s, _ in rows}
    want = sorted((a, b) for a, b in pairs if (b, a) in pairs)
    assert want == [(1, 2), (2, 1), (3, 4), (4, 3)]
    assert run("bidirectional_edges", spark, sf) == want


def test_components_cliques_cover_whole(spark, tmp_path):
    # collections 5 and 0; k of different tens
    events = [(i, datetime(2024, 1, 1, 0, i), u, kind, 1.0, f'{{"k": {k}}}') for i, (u, kind, k) in enumerate([(5, "a", 1), (15, "a", 55), (25, "a", 92), (35, "b", 3), (10, "a", 7), (20, "a", 77)])]
    sf = put(spark, tmp_path, events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    nodes = {(u % 10, f"{u}.0", kind) for _, _, u, kind, _, _ in events}
    groups = {}
    for c, n, kind in nodes:
        groups.setdefault((c, kind), []).append(n)
    assert run("connected_components", spark, sf) == sorted((n, min(g)) for g in groups.values() for n in g)
    # a node without links is a clique and a group of its own
    found = sorted(sorted(g) for g in groups.values())
    assert [m for m, in run("maximal_cliques", spark, sf)] == found == [["10.0", "20.0"], ["15.0", "25.0", "5.0"], ["35.0"]]
    assert sorted(m for _, m in run("graph_cover", spark, sf)) == found


def test_divisors_whole(spark, tmp_path):
    keys = [0, 1, 2, 3, 4, 6, 12, 59, 61, 90, 118, 120, 180, 360]
    sf = put(spark, tmp_path, part=([(k,) for k in keys], "p_partkey long"))
    pairs = {(a, b) for a in keys for b in keys if 0 < a < b and b % a == 0}
    assert run("transitive_successors", spark, sf) == sorted(pairs)
    assert run("transitive_reduction", spark, sf) == sorted((a, b) for a, b in pairs if not any((a, m) in pairs and (m, b) in pairs for m in keys))


def test_order_lines_whole(spark, tmp_path):
    # a path c1 s1 c2 s2 ... of 12 customers
    lines = [(c, s, c % 2 + 2, "N", 5.0) for c in range(1, 13) for s in (c - 1, c) if s]
    sf = put(
        spark, tmp_path,
        lineitem=(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double"),
        orders=([(c, c, "5-LOW") for c in range(1, 13)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        customer=([(c,) for c in range(1, 13)], "c_custkey long"), supplier=([(c,) for c in range(1, 13)], "s_suppkey long"),
    )
    path = [x for i in range(1, 13) for x in (f"c{i}", f"s{i}")]
    assert run("bfs_distance", spark, sf) == sorted(("s1", x, abs(i - 1)) for i, x in enumerate(path))
    assert run("bridges", spark, sf) == sorted(tuple(sorted(e)) for e in zip(path, path[1:]))
    assert registry.QUERIES["spanning_forest"](spark, sf).count() == 24
    songs = {r.song for r in registry.QUERIES["pattern_cover"](spark, sf).collect()}
    assert songs == set(range(1, 13))


def test_node_groups_by_class(spark, tmp_path, monkeypatch):
    """The groups of the general search, without its edges: a class of n nodes has n * n / 2."""
    from braidline.operators import growth
    from braidline.plans import timelines
    from braidline.sources import views

    rnd = random.Random(4)
    people = [None, *range(60)]
    events = [(i, datetime(2024, 1, 1, 0, 0, i // 60, i % 60), rnd.choice(people), rnd.choice(["a", "b", "c", None]), 1.0, '{"k": 1}') for i in range(700)]
    sf = put(spark, tmp_path, events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"))
    half = lambda c, i: F.split(c, "[.]")[i].cast("long")
    e = views.segment_edges(views.sequences(spark, sf))
    e = e.select("collection", half("src", 0).alias("v1"), half("src", 1).alias("t1"), half("dst", 0).alias("v2"), half("dst", 1).alias("t2"))
    want = sorted(tuple(r) for r in growth.node_groups(e, "collection", count=10).collect())
    monkeypatch.setattr(views, "segment_edges", None)
    assert len({r[:2] for r in want}) > 50
    assert run("node_groups", spark, sf) == want
    assert "Pandas" not in timelines.node_groups(spark, sf)._jdf.queryExecution().toString()
