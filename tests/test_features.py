"""Feature points: catalogue, segmentations, and each kind of feature by hand."""

from braidline.operators import features as f


def times(spark, *t):
    return spark.createDataFrame([(1, float(x)) for x in t], "v long, time double")


def test_catalogue_and_files(spark):
    assert f.FEATURES["madbeats"] == ("madbars", True) and f.FEATURES["johan7"] == ("johan", False)
    files = spark.createDataFrame([("f/a/a_johan.json",), ("f/a/a_johan2.json",), ("f/a/a_johan0.txt",), ("f/johan/b_chroma.json",)], "path string")
    got = f.feature_files(files, ["johan7", "chroma", "mfcc"]).collect()
    assert {tuple(r) for r in got} == {("f/a", "johan7", "f/a/a_johan.json"), ("f/johan", "chroma", "f/johan/b_chroma.json")}


def test_segments(spark):
    t = times(spark, 4, 0, 1, 1, 2, 3).unionByName(spark.createDataFrame([(1, None)], "v long, time double"))
    assert [tuple(r) for r in f.segments(t, "v").orderBy("i").collect()][-2:] == [(1, 3, 3.0, 4.0), (1, 4, 4.0, None)]
    assert [tuple(r) for r in f.segments(t, "v", doubletime=True).orderBy("i").collect()] == [(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (1, 2, 4.0, None)]


def test_bars(spark):
    beats = times(spark, *range(10))
    bars = f.bars_by_changes(beats, times(spark, 1.1, 5.2, 9, 2.9), "v")
    assert [r.time for r in bars.orderBy("time").collect()] == [1, 5, 9]
    none = f.bars_by_changes(beats, times(spark, 1).where("time > 1"), "v")
    assert [r.time for r in none.orderBy("time").collect()] == [0, 4, 8]


def points(spark, features, **options):
    rows = f.feature_points(f.segments(times(spark, 0, 10, 20), "v"), features, "v", width=7.0, **options).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def test_labels(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 4.0, "a"), (1, 1, 4.0, 12.0, "b"), (1, 2, 12.0, 21.0, "c"), (1, 3, 21.0, 60.0, "d"), (1, 4, None, 70.0, "e")], "v long, idx long, start double, end double, label string")
    assert points(spark, [f.Feature("l", "label", rows)]) == [(0, 0.0, "b"), (1, 10.0, "c"), (2, 20.0, "d")]


def test_means(spark):
    schema = "v long, start double, duration double, value double"
    rows = spark.createDataFrame([(1, 0.0, None, 2.0), (1, 8.0, 4.0, 4.0), (1, 11.0, 0.0, None), (1, 25.0, 1.0, 7.0)], schema)
    assert points(spark, [f.Feature("m", "mean", rows)]) == [(0, 0.0, 3.0), (1, 10.0, 4.0), (2, 20.0, 7.0)]
    assert points(spark, [f.Feature("m", "mean", rows)], published_shift=True) == [(0, 0.0, 4.0), (1, 10.0, 7.0)]
    vectors = spark.createDataFrame([(1, 1.0, 0.0, [1.0, 5.0]), (1, 2.0, 0.0, [3.0, 7.0]), (1, 20.0, 0.0, [0.0, 1.0])], schema.replace("value double", "value array<double>"))
    assert points(spark, [f.Feature("m", "mean", vectors)]) == [(0, 0.0, [2.0, 6.0]), (2, 20.0, [0.0, 1.0])]  # a row without a mean goes


def test_pitches(spark):
    notes = [(0.0, 9.0, 60), (1.0, 3.0, 64), (4.0, 3.0, 76), (2.0, 5.0, 67), (3.0, 4.0, 69), (8.0, 1.0, 61), (22.0, 0.1, 62)]
    rows = spark.createDataFrame([(1, *n) for n in notes], "v long, start double, duration double, value long")
    # 61 fills a tenth of its segment; 64 and 76 sound 6 together; the last segment knows no share
    assert points(spark, [f.Feature("p", "pitches", rows)]) == [(0, 0.0, [0, 4, 7]), (1, 10.0, []), (2, 20.0, [2])]
    assert points(spark, [f.Feature("p", "pitches", rows)], published_shortest=True)[0] == (0, 0.0, [4, 7, 9])
    both = points(spark, [f.Feature("p", "pitches", rows), f.Feature("m", "mean", rows)])
    assert [r[0] for r in both] == [0, 2]


def test_nothing(spark):
    rows = spark.createDataFrame([], "v long, start double, duration double, value double")
    assert points(spark, [f.Feature("m", "mean", rows)]) == []
    assert points(spark, [f.Feature("p", "pitches", rows)]) == [(0, 0.0, []), (1, 10.0, []), (2, 20.0, [])]
