"""Goldens of the small graph and its slices."""

import pytest
from pyspark.sql import functions as F

from braidline.operators import graph_local, partition
from braidline.operators.components import connected_components
from braidline.operators.graph import Graph


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(str(i),) for i in range(1, 7)], "id string")
    edges = spark.createDataFrame([(0, "1", "2"), (1, "2", "1"), (2, "2", "3"), (3, "5", "6")], "eid long, src string, dst string")
    return Graph.of(nodes, edges)


@pytest.fixture(scope="module")
def slices(spark):
    return spark.createDataFrame([("2", 0), ("3", 0), ("1", 1), ("4", 1), ("5", 1), ("6", 2)], "node_id string, slice long")


def dense(cells, n):
    m = [[0] * n for _ in range(n)]
    for r in cells.collect():
        m[r.i][r.j] = r.n
    return m


def test_degrees(small):
    assert {r.id: r.degree for r in small.degrees().collect()} == {"1": 2, "2": 3, "3": 1, "4": 0, "5": 1, "6": 1}


def test_components_and_adjacents(small, spark):
    sizes = sorted((r["count"] for r in small.components().groupBy("component").count().collect()), reverse=True)
    assert sizes == [3, 2, 1]
    one = spark.createDataFrame([("1",)], "id string")
    assert small.adjacents(one, 1).count() == 1
    assert small.adjacents(one, 2).count() == 2
    assert {(r.id, r.distance) for r in small.distances(one).collect()} == {("1", 0), ("2", 1), ("3", 2)}


def test_isolated_bidirectional_contract(small, spark):
    assert [r.id for r in small.isolated().select("id").collect()] == ["4"]
    assert {(r.src, r.dst) for r in small.bidirectional().collect()} == {("1", "2"), ("2", "1")}
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    assert {(r.src, r.dst) for r in small.contract(ids, "1").collect()} == {("1", "3"), ("5", "6")}
    assert small.contract(ids, "1", outgoing_only=True).count() == 3


def test_matrix_goldens(small, slices):
    m = lambda p, n: dense(partition.connection_matrix(small.edges, p), n)
    assert m(slices, 3) == [[1, 2, 0], [2, 0, 1], [0, 1, 0]]
    assert m(slices.where("node_id <> '1'"), 3) == [[1, 0, 0], [0, 0, 1], [0, 1, 0]]
    moved = slices.withColumn("slice", F.when(F.col("node_id").isin("1", "5"), 2).otherwise(F.col("slice")))
    assert m(moved, 3) == [[1, 0, 2], [0, 0, 0], [2, 0, 1]]
    assert m(partition.merge(slices, 0, 2), 2) == [[1, 3], [3, 0]]
    assert m(partition.merge(slices, 0, 1), 2) == [[3, 1], [1, 0]]
    assert m(partition.renumber(slices.where("slice <> 1")), 2) == [[1, 0], [0, 0]]
    assert m(partition.drop_small(slices, 3), 1) == [[0]]
    assert dense(partition.connection_matrix(small.edges, slices, doubled_diagonal=True), 3)[0][0] == 2


def test_components_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500}
    assert connected_components(e.limit(0)).count() == 0


def test_local_algorithms():
    near = {"a": {"b", "c"}, "b": {"a", "c"}, "c": {"a", "b", "d"}, "d": {"c"}}
    assert graph_local.bridge_pairs(near) == [("c", "d")]
    assert sorted(graph_local.cliques_of(near)) == [["a", "b", "c"], ["c", "d"]]
    assert graph_local.cover_of(near) == [("c", ["a", "b", "c", "d"])]
    assert len(graph_local.chains_of(near)) == 1
    assert [x[2] for x in graph_local.forest_of(near)] == [0, 1, 1, 2]


def test_reduction_and_closure(spark):
    n = spark.createDataFrame([(i,) for i in range(4)], "id long")
    g = Graph.of(n, spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 0, 2), (3, 2, 3)], "eid long, src long, dst long"))
    assert {(r.src, r.dst) for r in g.transitive_reduction().collect()} == {(0, 1), (1, 2), (2, 3)}
    assert g.closure().count() == 6


def test_validity(spark):
    p = spark.createDataFrame([("a", 0, 1, 5), ("b", 0, 1, 3), ("c", 1, 1, 2), ("d", 1, 2, 1)], "node_id string, slice long, version long, time long")
    assert {r.node_id for r in partition.one_per_version(p).collect()} == {"b", "c", "d"}
    assert [(r.version, r.slice) for r in partition.contradictions(p).collect()] == [(1, 1)]
    assert partition.insert_slice(p.select("node_id", "slice"), spark.createDataFrame([("a",), ("z",)], "node_id string"), 1).where("slice = 1").count() == 1
