"""Growth, training, evaluation and constraints: brute force and invariants."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from braidline.operators import align, evaluation, graph_local, growth, hmm, interval, partition, patterns
from braidline.operators.graph import Graph
from braidline.operators.search import rating, valid


def path_sum(model, seq):
    """The likelihood, one path at a time."""
    t, n = model.transitions, model.n

    def rest(state, k, r):
        total = (1 - t[n, state].sum()) if k == n and r == len(seq) else 0.0
        if r < len(seq):
            total += t[k, state, 1] * model.insert[k, seq[r]] * rest(1, k, r + 1)
            if k < n:
                total += t[k, state, 0] * model.emit[k + 1, seq[r]] * rest(0, k + 1, r + 1)
        if k < n:
            total += t[k, state, 2] * rest(2, k + 1, r)
        return total

    return rest(0, 0, 0)


def test_expectations():
    rng = random.Random(3)
    model = hmm.ProfileModel(3, 3, hmm.ProfileOptions(match_match=0.7, delete_insert=0.2))
    model.emit = np.array([[1 / 3] * 3, [0.6, 0.2, 0.2], [0.1, 0.8, 0.1], [0.3, 0.3, 0.4]])
    seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 5))] for _ in range(6)]
    total, moves, emit, inserted = model.expected(seqs)
    assert math.isclose(total, sum(math.log(path_sum(model, s)) for s in seqs), rel_tol=1e-9)
    assert math.isclose(emit.sum() + inserted.sum(), sum(map(len, seqs)), rel_tol=1e-9)
    assert math.isclose(moves[:, :, 3].sum(), len(seqs), rel_tol=1e-9)


def test_training_raises_likelihood():
    seqs = [[0, 1, 2, 1], [0, 1, 2, 1], [0, 1, 1], [0, 2, 2, 1]]
    model = hmm.ProfileModel(4, 3, hmm.ProfileOptions(iterations=1, edge_inertia=0.0, emission_inertia=0.0, pseudocount=0.0, match_match=0.8))
    seen = []
    for _ in range(5):
        seen.append(model.expected(seqs)[0])
        before = model.transitions.copy()
        model.fit(seqs)
    assert all(b >= a - 1e-9 for a, b in zip(seen, seen[1:])) and not np.allclose(before, hmm.ProfileModel(4, 3, model.options).transitions)


def clusters(n_versions=4, n_times=5):
    """Versions that play the same positions in the same order."""
    nodes = [(v, t) for v in range(n_versions) for t in range(n_times)]
    return {x: {y for y in nodes if y[1] == x[1] and y != x} for x in nodes}


def test_growth():
    near = clusters()
    for method in ("successive", "disjunct"):
        found, value = growth.grown(near, near, method=method)
        assert [sorted(s) for s in found] == [[(v, t) for v in range(4)] for t in range(5)] and value > 0
    groups = growth.successive_groups(near, growth.different_versions, 3)
    assert len(groups) == 3 and len({x for g in groups for x in g}) == 12
    assert growth.successive_groups({}, growth.different_versions, 3) == [] and growth.grown({}, [])[0] == []


def test_improvements_keep_constraints():
    rng = random.Random(5)
    near = clusters()
    for _ in range(20):
        slices = [[x for x in near if rng.random() < 0.25] for _ in range(4)]
        held, value = growth.improved(slices, near, near)
        assert value >= rating(valid(slices), near) - 1e-9 and held == valid(held)
        for kind in growth.IMPROVEMENTS.values():
            for c in kind(held, near, near):
                assert len({x for s in c for x in s}) == sum(map(len, c))


def test_conditions():
    near = clusters()
    assert growth.different_versions((1, 2), [(0, 0), (1, 1)], near) is None
    assert growth.apart(3)((1, 9), [(1, 1)], near) and growth.apart(30)((1, 9), [(1, 1)], near) is None
    assert growth.similar_time(2)((1, 9), [(0, 1)], near) is None
    assert growth.better_linked((1, 0), [(0, 0), (1, 3)], near) == [(0, 0), (1, 0)]
    assert growth.better_linked((0, 1), [(0, 0)], near) is None
    left = growth.without_members([(3, [(0, 0), (1, 0), (2, 0)])], [(0, 0)], near)
    assert left == [(1, [(1, 0), (2, 0)])] and growth.unique_members(left) == [(1, 0), (2, 0)]


def test_places():
    near = clusters()
    slices = [[(v, t) for v in range(1, 4)] for t in range(3)]
    assert growth.place((0, 1), slices, near)[1][-1] == (0, 1)
    assert growth.place((1, 9), slices, {}, insert=True)[-1] == [(1, 9)]
    assert growth.completed([None, 2, None, 4, None]) == [0, 2, 3, 4, 5]
    moved = [[(0, 1)], [(1, 1), (2, 1)], [(1, 2), (2, 2), (0, 3)], [(1, 3), (2, 3)]]
    assert any((0, 1) in s[1] and (0, 3) in s[3] for s in growth.slides(moved, near))
    assert growth.strays([[(0, 1)], [(1, 1), (2, 1)]], near) == [(0, 1)]


def test_shares():
    assert evaluation.aligned_shares(list("abcd"), list("xbcdx")) == (0.75, 0.6)
    assert evaluation.aligned_shares([], ["a"]) == (0.0, 0.0)
    assert evaluation.self_alignment([0, 1, 2, 0, 1, 2], least=3) == [(0, 3), (1, 4), (2, 5)]
    good, bad = [(i, i) for i in range(6)], [(0, 5), (5, 0)]
    assert evaluation.coherent_subset([good, bad]) == [good]


def test_uncovered_segments(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 5.0, 6.0), (1, 2, 20.0, 21.0), (2, 0, 0.0, 1.0)], "v int, i int, start double, end double")
    l = spark.createDataFrame([(1, 0, 4.0, 5.5, "a"), (1, 1, 5.5, 8.0, "b")], "v int, idx int, start double, end double, label string")
    got = {(r.v, r.i): (r.label, r.overlap) for r in interval.overlap_argmax(s, l, "v", width=2.0).collect()}
    assert got == {(1, 0): ("a", 0.0), (1, 1): ("a", 0.5), (1, 2): ("b", 0.0), (2, 0): (None, 0.0)}


def test_isolated_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    g = Graph.of(nodes, spark.createDataFrame([("a", "b", "e")], "src string, dst string, eid string"))
    assert sorted(r.members for r in graph_local.maximal_cliques(g).collect()) == [["a", "b"], ["c"]]
    assert {r.id for r in graph_local.spanning_forest(g).collect()} == {"a", "b", "c"}
    assert {m for r in graph_local.graph_cover(g).collect() for m in r.members} == {"a", "b", "c"}


def test_set_pairs(spark):
    rng = random.Random(9)
    sets = {i: frozenset(rng.sample(range(9), rng.randint(1, 6))) for i in range(60)}
    rows = spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], "pid int, token int")
    pairs = list(itertools.combinations(sets, 2))
    j = {(r.a, r.b) for r in patterns.jaccard_pairs(rows, "pid", "token", 0.6).collect()}
    assert j == {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    d = {(r.a, r.b) for r in patterns.dice_pairs(rows, "pid", "token", 0.8).collect()}
    assert d == {(a, b) for a, b in pairs if 2 * len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) + len(sets[b]))}
    n = {(r.a, r.b) for r in patterns.same_but_n(rows, "pid", "token", 2).collect()}
    assert n == {(a, b) for a, b in pairs if sets[a] & sets[b] and len(sets[a] ^ sets[b]) <= 2}
    i = {(r.inner, r.outer) for r in patterns.subset_pairs(rows, "pid", "token").collect()}
    assert i == {(a, b) for a, b in itertools.permutations(sets, 2) if sets[a] < sets[b]}


def test_groups_of_three(spark):
    v = spark.range(7).select(F.lit(0).alias("c"), F.col("id").alias("version"))
    got = align.disjoint_pairs(v, "c", size=3).collect()
    assert len(got) == 6 and len({x for r in got for x in (r.v1, r.v2)}) == 6


def test_order_sides(spark):
    p = spark.createDataFrame([(0, "x0", 0, 5, 0), (0, "x1", 0, 7, 1), (0, "x2", 0, 3, 2), (0, "x3", 0, 9, 3)], "c int, node_id string, version int, time int, slice int")
    assert {r.slice for r in partition.out_of_order(p, ["c"]).collect()} == {0, 2}
