"""Hand-computed values, brute force and invariants of single operators."""

import itertools
import json
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidline.functions import theory
from braidline.operators import align, arrays, classify, experiment, hmm, interval, patterns, search, structure
from braidline.sources import formats


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_theory(spark):
    lab = lambda *p: theory.pc_set_label(F.array(*map(F.lit, p)))
    assert one(spark, lab(0, 4, 7), lab(0, 3, 8), lab(2, 5, 9), lab(0, 3, 6), lab(0, 4, 8)) == ("C", "Ab", "Dm", "C°", "C+")
    q = lambda x: theory.triad_quality(F.lit(x))
    assert one(spark, q("Cmaj7"), q("Am"), q("Bdim"), q("F#aug")) == ("maj", "min", "dim", "aug")
    p = lambda x: theory.pitch_class(F.lit(x))
    assert one(spark, p("Cb"), p("B#"), p("F#m"), p("H")) == (11, 0, 6, None)
    assert one(spark, theory.label_to_pc_set(F.lit("Am")), theory.label_to_pc_set(F.lit("C"), True)) == ([0, 4, 9], [0, 4, 7, 11])
    assert one(spark, theory.pc_set(F.array(*map(F.lit, [14, 2, -1]))), theory.fold_difference(F.lit(9))) == ([2, 11], -3)
    k = lambda *a: theory.key_difference(*map(F.lit, a))
    assert one(spark, k(0, "major", 9, "minor"), k(0, "major", 0, "minor"), k(0, "major", 7, "major")) == (0, 0, -5)
    assert one(spark, theory.tuning_ratio(F.lit(5), F.lit(440.0), F.lit(440.0)))[0] == 1.0


def brute_local(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 0.7, h[i][j - 1] - 0.7)
    return h


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_score_matrix(a, b):
    h = align.score_matrix(a, b)
    assert all(math.isclose(h[i][j], x, abs_tol=1e-9) for i, r in enumerate(brute_local(a, b)) for j, x in enumerate(r))
    for path in align.local_paths(a, b, least=1):
        assert all(a[i] == b[j] for i, j in path) and path == sorted(path)


def test_pattern_cover():
    found = align.cover_of([(0, 0), (1, 2), (5, 0), (6, 2), (9, 9)])
    assert found[0] == ([(0, 0), (1, 2)], [(0, 0), (5, 0)]) and found[-1][0] == [(9, 9)]


def test_profile_model():
    m = hmm.ProfileModel(4, 3, hmm.ProfileOptions())
    assert all(abs(m.transitions[k].sum(1) - 1).max() < 1e-9 for k in range(4))
    seqs = [[0, 1, 2, 1], [0, 1, 2, 1], [0, 1, 1]]
    m = hmm.ProfileModel(4, 3, hmm.ProfileOptions(iterations=3, emission_inertia=0.2)).fit(seqs)
    states, logp = m.viterbi([0, 1, 2, 1])
    assert states == [1, 2, 3, 4] and logp < 0
    got = [s for s in m.viterbi([0, 1, 1])[0] if s is not None]
    assert got == sorted(got) and hmm.profile_length([3, 4, 9]) == 4


def test_sections_and_hierarchy():
    cells = [(a, b, 9) for a, b in ((0, 4), (1, 5), (2, 6))]
    assert structure.section_groups(cells + [(b, a, n) for a, b, n in cells]) == [[[0, 1, 2], [4, 5, 6]]]
    assert structure.section_groups([]) == []
    assert structure.pair_merges([0, 1, 0, 1, 2])[0] == (3, 0, 1, 2)


def test_search_is_valid():
    rnd = random.Random(3)
    near = {}
    for v, w in itertools.combinations(range(4), 2):
        for t in range(6):
            if rnd.random() < 0.8:
                near.setdefault((v, t), set()).add((w, t))
                near.setdefault((w, t), set()).add((v, t))
    slices, value = search.beam(search.seed(near), near)
    nodes = [x for s in slices for x in s]
    assert len(nodes) == len(set(nodes)) and value > 0
    for v in range(4):
        times = [t for s in slices for u, t in s if u == v]
        assert times == sorted(times)


def test_clusterings():
    pts = [[0.0], [0.1], [0.2], [5.0], [5.1], [9.0]]
    assert classify.ward_labels(pts, 3) == [0, 0, 0, 1, 1, 2]
    assert sorted(i for i, _ in classify.optics_order(pts, 2)) == list(range(6))
    xy = classify.classical_mds([[0, 3, 4], [3, 0, 5], [4, 5, 0]])
    assert math.isclose(math.dist(xy[1], xy[2]), 5, rel_tol=1e-6)


def test_dbscan(spark):
    v = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate([0, 1, 2, 10, 11, 30])], "id long, v array<double>")
    got = {r.id: r.cluster for r in classify.dbscan(v.select("id"), classify.pair_distances(v), 1.0, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: -1}


def test_cosine_pairs_by_blocks(spark, monkeypatch):
    """Every pair of a group, from parts that meet; odd vectors have no cosine."""
    rnd = random.Random(5)
    rows = [(i, i % 2, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(90)]
    rows += [(90, 0, None), (91, 0, [1.0, None, 1.0, 1.0, 1.0]), (92, 1, [1.0, 2.0]), (93, None, [1.0] * 5), (None, 0, [1.0] * 5), (94, 0, [0.0] * 5)]
    monkeypatch.setattr(align, "ROWS", 8)
    found = align.cosine_pairs(spark.createDataFrame(rows, "id long, g int, v array<double>"), "id", "v", "g")
    assert "Join" not in found._jdf.queryExecution().analyzed().toString().split("FlatMapGroups")[0]  # pairs are made in the tasks
    got = {(r.g, r.a, r.b): r.cosine for r in found.collect()}
    sound = {i: v for i, _, v in rows if v and None not in v}
    want = {(g, a, b) for a, g, _ in rows for b, h, _ in rows if g == h and g is not None and a is not None and b is not None and a < b}
    assert set(got) == want
    for (_, a, b), c in got.items():
        x, y = sound.get(a), sound.get(b)
        if x is None or y is None or len(x) != len(y):
            assert c is None
        elif not any(x) or not any(y):
            assert math.isnan(c)
        else:
            dot = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(p * p for p in y))
            assert abs(c - dot) <= 5.1e-7 and c == round(c, 6)


def test_overlaps_claimed_without_frames(spark):
    """Longest patterns claim rows and columns first, no frame is made of a pair; scores are
    those of the recurrence, cell by cell."""
    cells = [(1, p, q, x, y) for p, path in enumerate([[(0, 0), (1, 1)], [(1, 0), (2, 1), (3, 2)], [(4, 4), (5, 2)]]) for q, (x, y) in enumerate(path)]
    found = align.without_overlaps(spark.createDataFrame(cells, "pair_id long, pattern int, pos int, t1 long, t2 long"))
    assert sorted((r.pattern, r.pos) for r in found.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert "Pandas" not in found._jdf.queryExecution().toString()
    rnd = random.Random(2)
    for n, m in ((1, 1), (1, 5), (6, 1), (7, 4), (3, 9), (0, 3), (3, 0)):
        a, b = (["xyz"[rnd.randrange(3)] for _ in range(k)] for k in (n, m))
        h = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
            h[i][j] = max(0, h[i - 1][j - 1] + (1.0 if a[i - 1] == b[j - 1] else -1.0), max(h[i - 1][j], h[i][j - 1]) - 0.7)
        assert align.score_matrix(a, b).tolist() == h


def test_dbscan_without_pairs(spark, monkeypatch):
    """Parts that meet give what all pairs of a key give: copies, borders, rows without a
    distance; the query lists no pairs."""
    rnd = random.Random(8)
    spot = lambda: [round(rnd.uniform(0, 6), 1), round(rnd.uniform(0, 6), 1)]
    rows = [(i, i % 3, spot()) for i in range(0, 300)]
    rows += [(300 + i, v[1], v[2]) for i, v in enumerate(rows[:40])] + [(400, 0, None), (401, 1, [1.0, None]), (402, 1, [math.nan, 1.0]), (403, 1, [math.nan, 1.0]), (404, None, [1.0, 1.0]), (405, 2, [1.0])]
    v = spark.createDataFrame(rows, "id long, label long, v array<double>")
    a, b = (v.select("label", F.col("id").alias(c), F.col("v").alias(f"v{c}")) for c in "ab")
    pairs = a.join(b, "label").where("a <> b").select("a", "b", classify.distance("va", "vb").alias("d"))
    monkeypatch.setattr(classify, "ROWS", 16)
    for eps, least in ((0.45, 4), (0.6, 6), (0.3, 1)):
        want = sorted(tuple(r) for r in classify.dbscan(v.select("id"), pairs, eps, least).collect())
        assert len({c for _, c in want}) > 5
        assert sorted(tuple(r) for r in classify.dbscan_points(v, "label", eps, least).collect()) == want


def test_sliding_and_prefix(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 5, "a"), (2, 6, "b"), (3, 0, "c")], "p long, t long, l string")
    assert [(r.a, r.b, r["shift"], r.jaccard) for r in patterns.sliding_pairs(rows, "p", "t", "l", 0.8).collect()] == [(1, 2, 5, 1.0)]
    assert patterns.published_jaccard(2, False) == 0.5 and patterns.published_jaccard(7, True) == 0.875


def test_nearest_ties(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 11.0), (2, 1.0)], "v long, at double")
    right = spark.createDataFrame([(1, 4.0, 0), (1, 6.0, 1), (1, 10.0, 2)], "v long, at double, n long")
    assert {(r.v, r.at): r.n for r in interval.nearest(left, right, "v", "at", "n").collect()} == {(1, 5.0): 0, (1, 11.0): 2, (2, 1.0): None}


def test_log_evolves(spark):
    log = spark.createDataFrame([(1, "x")], "a long, c string")
    out = experiment.append(log, spark.createDataFrame([(2, 7, "y")], "a long, b long, c string"))
    assert out.columns == ["a", "b", "c"] and out.count() == 2
    grid = experiment.config_grid(spark, {"a": [1, 2], "c": ["x"]})
    assert [r.a for r in experiment.pending(grid, log).collect()] == [2]


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"annotations":[{"data":[{"time":1.0,"duration":0.5,"value":"x "y" z"}]}]}')
    (tmp_path / "b.json").write_text("broken")
    rows = formats.jams_events(formats.whole_files(spark, str(tmp_path), "json")).collect()
    assert [(r.version, r.time, r.value) for r in rows] == [(0, 1.0, 'x "y" z')]
    (tmp_path / "c.tsv").write_text("0.5\t1\n1.0\t2\n1.5\t1\n")
    files = formats.whole_files(spark, str(tmp_path), "tsv")
    assert [r.time for r in formats.beats(files).collect()] == [0.5, 1.0, 1.5]
    assert [r.time for r in formats.beats(files, downbeats=True).collect()] == [0.5, 1.5]
    (tmp_path / "s.txt").write_text("0.0\tSilence\n1.0\tA, a, Verse\n2.0\tb\n3.0\tA, a', Chorus\n")
    ann = formats.annotations(formats.whole_files(spark, str(tmp_path), "txt"))
    assert [(r.label, r.length) for r in formats.sections(ann, "named").orderBy("i").collect()] == [("Verse", 2), ("Chorus", 1)]
    assert formats.lead_sheet({"_form": ["A", "B"], "A": ["x", "C G"], "B": "F", "x": "Am"}) == ["Am", "C", "G", "F"]
    seq = spark.createDataFrame([(0, 0, 0), (0, 1, 2)], "version long, time long, code int")
    formats.write_fasta(seq, str(tmp_path / "f"))
    assert [r.value for r in spark.read.option("lineSep", ">").text(str(tmp_path / "f")).collect() if r.value.strip()] == ["version0\nAC\n"]
    (tmp_path / "m.fasta").write_text(">version0\nA-C\n>version1\n-BC\n")
    got = {(r.version, r.column): r.state for r in formats.fasta_states(spark, str(tmp_path / "m.fasta")).collect()}
    assert got[(0, 1)] is None and got[(1, 2)] == 3
    (tmp_path / "songs.map").write_text(json.dumps({"s": {"r": [{"filename": "f1"}, {"filename": "f2"}]}}))
    assert formats.song_map(spark, str(tmp_path / "songs.map")).count() == 2


def test_array_helpers(spark):
    a = F.array(*map(F.lit, [1, 2, 3]))
    sets = one(spark, arrays.powerset(a))[0]
    assert sorted(sets) == sorted([[], [1], [2], [3], [1, 2], [1, 3], [2, 3], [1, 2, 3]])
    b = F.array(*map(F.lit, [1, 2]))
    assert one(spark, arrays.equal_sets(a, b), arrays.equal_sets(a, b, one_sided=True), arrays.proper_subset(b, a)) == (False, True, True)
    m, n = F.array(*map(F.lit, [1, 1, 2])), F.array(*map(F.lit, [1, 1, 1]))
    assert one(spark, arrays.multiset_common(m, n), arrays.multiset_union(m, n)) == (2, 4)
    assert one(spark, arrays.unique_name(F.lit("/a/b/c.wav"))) == ("b_c_wav",)
    assert len(arrays.combinations({"a": [1, 2], "b": [3]})) == 2
    part = spark.createDataFrame([(0, 1, 5), (1, 1, 2), (0, 2, 9), (1, 2, 3)], "slice long, version long, time long")
    assert [r.slice for r in arrays.in_time_order(part).orderBy("place").collect()] == [1, 0]
    events = spark.createDataFrame([(1, 0.2, 2.6)], "v long, start double, end double")
    grid = spark.createDataFrame([(1, float(i), i) for i in range(5)], "v long, at double, place long")
    assert arrays.to_grid(events, grid, "v").first().places == [0, 1]
    assert arrays.to_grid(events, grid, "v", rounded=True).first().places == [0, 1, 2]


def test_fit_grid():
    offset, unit = interval.fit_grid([0.52, 1.01, 1.49, 2.0, 2.52, 3.0])
    assert abs(unit - 0.5) < 0.02 and interval.grid_error([0.5, 1.0, 1.5], 0.5, 0.5) == 0
