"""Timelines: ratings after every change against a full count, and the searches."""

import random

import pytest

from braidline.operators import partition, timeline
from braidline.operators.timeline import Timeline


def graph(rnd, versions=6, length=9, chance=0.5):
    near = {}
    for v in range(versions):
        for w in range(v + 1, versions):
            for a in range(length):
                for b in (a - 1, a, a, a, a + 1):
                    if 0 <= b < length and rnd.random() < chance / 3:
                        near.setdefault((v, a), set()).add((w, b))
                        near.setdefault((w, b), set()).add((v, a))
    return near


def counted(t):
    """A timeline of the same slices, empty ones too, counted from nothing."""
    return Timeline.of(t.slices(), t.near)


def valid(t):
    at = [(v, x, i) for i, s in enumerate(t.slices()) for v, x in s]
    assert len({(v, x) for v, x, _ in at}) == len(at) == len(t.at) and len({(v, i) for v, _, i in at}) == len(at)
    assert all((x < y) == (i < j) for v, x, i in at for w, y, j in at if v == w and (x, i) != (y, j))


@pytest.mark.parametrize("seed", range(12))
def test_rating_after_every_change(seed):
    rnd = random.Random(seed)
    near = graph(rnd)
    t = Timeline(near)
    states = []
    for _ in range(120):
        states.append((len(t.log), t.slices(), t.rating()))
        step = rnd.random()
        if step < 0.5 and t.order:
            t.add(rnd.choice(sorted(near)), rnd.choice(t.order))
        elif step < 0.65:
            t.insert(rnd.randint(0, len(t.order)))
        elif step < 0.75 and t.at:
            t.remove(rnd.choice(sorted(t.at)))
        elif step < 0.85 and t.at:
            t.move(rnd.choice(sorted(t.at)), rnd.choice(t.order))
        elif step < 0.9 and len(t.order) > 2:
            t.drop(rnd.choice(t.order))
        else:
            rnd.choice(timeline.building(t) + timeline.clearing(t))(t)
        assert repr(t.factors()) == repr(counted(t).factors())
        valid(t)
    for mark, slices, value in reversed(states):
        t.back_to(mark)
        assert t.slices() == slices and t.rating() == value


@pytest.mark.parametrize("preset", ["msa", "good"])
def test_rating_is_that_of_the_frame(spark, preset):
    near = graph(random.Random(3))
    t = timeline.grow(near)._with(partition.PRESETS[preset])
    name = lambda n: f"{n[0]}.{n[1]}"
    edges = spark.createDataFrame([(name(a), name(b)) for a in near for b in near[a] if a < b], "src string, dst string")
    rows = [(0, name(n), i, *n) for i, s in enumerate(t.slices()) for n in s]
    p = spark.createDataFrame(rows, "g long, node_id string, slice long, version long, time long")
    cells = partition.connection_matrix(edges, p).selectExpr("0L AS g", "i", "j", "n")
    found = partition.sequence_rating(cells, p, ["g"], len(t.order), preset).first()
    assert found.rating == pytest.approx(t.rating(), abs=1e-9)
    assert {k: found[k] for k in partition.FACTORS} == pytest.approx(t.factors(), abs=1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_searches(seed):
    near = graph(random.Random(seed), chance=0.8)
    grown = timeline.grow(near)
    found = timeline.beam(grown.copy())
    wide = timeline.beam(grown.copy(), width=3)
    for t in (grown, found, wide):
        valid(t)
        assert t.rating() == pytest.approx(counted(t).rating()) and all(len(s) > 1 for s in t.slices())
    assert found.rating() >= grown.rating() > 0 and wide.rating() >= grown.rating()
    for kinds in (timeline.building, timeline.clearing):  # no candidate improves what was found
        for change in kinds(found):
            mark = len(found.log)
            timeline.tried(found, change, 2.0)
            found.back_to(mark)
            assert found.rating() == pytest.approx(counted(found).rating())


def test_beam_ends_at_a_best():
    found = timeline.beam(timeline.grow(graph(random.Random(9), chance=0.9)))
    value = found.rating()
    for change in timeline.building(found) + timeline.clearing(found):
        mark = len(found.log)
        assert timeline.tried(found, change, 2.0) <= value + 1e-12
        found.back_to(mark)


def test_aligned_versions():
    """Versions that agree at every position give the positions back."""
    near = {(v, x): {(w, x) for w in range(5) if w != v} for v in range(5) for x in range(12)}
    t = timeline.beam(timeline.grow(near))
    assert t.slices() == [[(v, x) for v in range(5)] for x in range(12)]
    assert timeline.beam(timeline.grow({})).slices() == []


def test_what_clears():
    near = {(0, 0): {(1, 0), (1, 1)}, (1, 0): {(0, 0)}, (1, 1): {(0, 0), (2, 1)}, (2, 1): {(1, 1)}, (3, 1): {(2, 5)}, (2, 5): {(3, 1)}}
    t = Timeline.of([[(0, 0), (1, 0)], [(1, 1), (2, 1), (3, 1)]], near)
    assert timeline.blurs(t) == [(0, 0)] and timeline.strays(t) == []
    assert timeline.unlinked(t) == [(3, 1)] and timeline.outside(t) == [(3, 1)]
    assert t.fits((2, 5), t.order[1]) is False and t.fits((0, 3), t.order[1]) and not t.fits((0, 3), t.order[0])


@pytest.mark.parametrize("seed", range(4))
def test_candidates_that_go_the_same_way_go_it_once(seed, monkeypatch):
    """A round rates each candidate as ``tried`` does, but makes every group once."""
    t = timeline.grow(graph(random.Random(seed), versions=8, length=20, chance=0.9))
    for n in sorted(t.at)[::3]:
        t.remove(n)
    made, insert = [], timeline.insert_group
    monkeypatch.setattr(timeline, "insert_group", lambda t, g: (made.append(g), insert(t, g)))
    for kinds in (timeline.building, timeline.clearing):
        found, before = timeline.ratings(t, kinds, 2.0), t.slices()
        groups = len(made)
        for change, value in zip(kinds(t), found, strict=True):
            mark = len(t.log)
            assert timeline.tried(t, change, 2.0) == value
            t.back_to(mark)
        assert t.slices() == before
        if kinds is timeline.building:
            mark, made[:] = len(t.log), []
            timeline.add_groups(t)
            t.back_to(mark)
            assert len(made) == groups > 0
