"""Sections of slices: a golden for each rule, levels and alignments against plain versions."""

import random

from braidline.operators import levels


def test_rules():
    # slices that are linked and follow one another are one run
    assert levels.sections_of([(0, 1), (1, 2)]) == [[[0, 1, 2]]]
    # components that move on by one are the places of a section, and alone slices sections
    assert levels.sections_of([(0, 4), (1, 5), (2, 6)], range(8)) == [[[0, 1, 2], [4, 5, 6]], [[3]], [[7]]]
    # single runs of different lengths become types of their own
    assert levels.sections_of([(0, 1), (1, 5)]) == [[[0, 1]], [[5]]]
    # single slices next to one another join (5, 6), before types are split by length
    assert levels.sections_of([(0, 5), (5, 6)]) == [[[0]], [[5, 6]]]
    # types that always follow one another are one: (0, 1) and (2, 3) after each other twice
    assert levels.join_adjacent([[[0, 1], [6, 7]], [[2, 3], [8, 9]]]) == [[[0, 1, 2, 3], [6, 7, 8, 9]]]
    assert levels.join_adjacent([[[0], [4]], [[1], [6]]]) == [[[0], [4]], [[1], [6]]]
    assert levels.join_adjacent([[[0], [4]], [[1]]]) == [[[0], [4]], [[1]]]
    assert levels.sections_of([]) == []


def plain_levels(m, least):
    """Level by level over the whole matrix."""
    m, n, out = [list(r) for r in m], len(m), []
    while True:
        def best(i, js):
            js = [j for j in js if m[i][j] > 0]
            return max(js, key=lambda j: (m[i][j], -j)) if js else None

        later = [best(i, range(i + least + 1, n)) for i in range(n)]
        earlier = [best(i, range(0, max(0, i - least))) for i in range(n)]
        links = [(i, j) for i, j in enumerate(later) if j is not None and earlier[j] == i]
        if not links:
            return out
        out.append(links)
        for i, j in links:
            m[i][j] = m[j][i] = 0


def test_peel():
    for seed in range(40):
        rnd = random.Random(seed)
        n, least = rnd.randrange(1, 9), rnd.randrange(3)
        m = [[rnd.choice([0, 0, 1, 2, 3]) for _ in range(n)] for _ in range(n)]
        cells = [(i, j, m[i][j]) for i in range(n) for j in range(n)]
        rnd.shuffle(cells)
        want = plain_levels(m, least)
        assert levels.peel(cells, least_distance=least) == want
        assert levels.peel(cells, least_distance=least, most=1) == want[:1]


def test_levels_of_keys(spark):
    rnd = random.Random(2)
    half = {(key, i, j): float(rnd.randrange(4)) for key in "ab" for i in range(7) for j in range(i + 1, 7)}
    cells = [(key, *at, v) for (key, i, j), v in half.items() for at in ((i, j), (j, i))]
    matrix = spark.createDataFrame([(*c, "x") for c in cells] + [("a", None, 1, 9.0, "x"), ("a", 0, 1, None, "x")], "key string, i long, j long, n double, level string")
    slices = spark.createDataFrame([(k, s) for k in "abc" for s in range(8)] + [("a", 0)], "key string, slice long")
    got: dict = {}
    for r in levels.segmentation_levels(matrix, slices, ["key"]).collect():
        got.setdefault((r.key, r.level), []).append((r.section, r.occurrence, r.position, r.slice))
    want = {}
    for key in "ab":
        for n, links in enumerate(levels.peel([c[1:] for c in cells if c[0] == key])):
            found = levels.sections_of(links, range(8))
            want[key, n] = [(t, o, p, s) for t, runs in enumerate(found) for o, r in enumerate(runs) for p, s in enumerate(r)]
    assert {k: sorted(v) for k, v in got.items()} == want and len(want) > 2
    assert all(sorted(s for *_, s in v) == list(range(8)) for v in got.values())
    assert levels.segmentation_levels(matrix.limit(0), slices.limit(0), ["key"]).count() == 0


def plain_segments(labels, shortest, gap):
    out = []
    n = len(labels)
    for lag in range(1, n):
        hits = [i for i in range(n - lag) if labels[i] is not None and labels[i] == labels[i + lag]]
        runs: list = []
        for i in hits:
            if runs and i - runs[-1][-1] <= gap + 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        out += [(lag, r[0], r[-1], len(r)) for r in runs if r[-1] - r[0] + 1 >= shortest]
    return sorted(out)


def test_alignment_and_types(spark):
    rnd = random.Random(4)
    texts = {"a": list("xyzwvxyzwvqq"), "b": [rnd.choice("xyz") for _ in range(30)], "c": [None, "x"], "d": list("abcxefgabcyefg")}
    df = spark.createDataFrame([(k, i, c) for k, v in texts.items() for i, c in enumerate(v)], "key string, slice long, label string").repartition(3)
    for shortest, gap in ((3, 0), (4, 2), (7, 1)):
        got: dict = {k: [] for k in texts}
        for r in levels.alignment_segments(df, ["key"], shortest=shortest, gap=gap).collect():
            got[r.key].append((r.lag, r.start, r.stop, r.matches))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain_segments(v, shortest, gap) for k, v in texts.items()}

    def sections(**options):
        out: dict = {}
        for r in sorted(levels.structure_by_alignment(df, ["key"], **options).collect(), key=lambda r: (r.key, r.section, r.occurrence, r.position)):
            types = out.setdefault(r.key, {})
            types.setdefault((r.section, r.occurrence), []).append(r.slice)
        return {k: list(v.values()) for k, v in out.items()}

    exact, filled = sections(shortest=3), sections(shortest=7, gap=1)
    assert exact["a"] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11]]
    # the odd slice in the middle is filled only where gaps may be
    assert filled["d"] == [[0, 1, 2, 3, 4, 5, 6], [7, 8, 9, 10, 11, 12, 13]] and exact["d"] != filled["d"]
    assert exact["c"] == [[0, 1]]
    types = {(r.key, r.slice): (r.type, r.occurrence) for r in levels.structure_by_types(df, ["key"]).collect()}
    assert [types["a", i] for i in range(12)] == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (5, 1)]
    assert ("c", 0) not in types and types["c", 1] == (0, 0)
