"""Groups and tables that are larger than one matrix or one list of pairs."""

import os
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidline.operators import align, blocks, classify, patterns
from braidline.operators.graph import Graph
from braidline.plans import registry

SF = "/root/testdata/sf0.001"


def test_ward_holds_no_matrix():
    x = np.random.default_rng(1).random((3000, 5))
    tracemalloc.start()
    labels = classify.ward_labels(x, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(labels) == {0, 1, 2} and peak < 16e6  # the matrix has 72 MB


def test_ward_counts_equal_points_once():
    r = np.random.default_rng(2)
    for _ in range(20):
        x = r.random((12, 3))[r.integers(0, 12, 60)]
        d = [(min(h, 9), a, b) for h, a, b in classify._ward_merges(x, np.ones(60))]
        up = list(range(60))
        for _, a, b in sorted(d, key=lambda m: m[0])[:57]:
            up = [up[a] if k == up[b] else k for k in up]
        names = {k: i for i, k in enumerate(dict.fromkeys(up))}
        assert classify.ward_labels(x, 3) == [names[k] for k in up]
    assert len(set(classify.ward_labels(np.zeros((9, 2)), 3))) == 3


@pytest.mark.parametrize("broad", [0, 256])
def test_mds_is_that_of_the_distances(spark, monkeypatch, broad):
    monkeypatch.setattr(classify, "BROAD", broad)
    r = np.random.default_rng(3)
    groups = {g: r.random((n, 4)) * [3, 2, 1, 0.5] for g, n in ((1, 40), (2, 7), (3, 1))}
    rows = [(g, 100 * g + i, p.tolist()) for g, v in groups.items() for i, p in enumerate(v)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "label long, id long, v array<double>")
    got = {t.id: (t.x, t.y) for t in classify.mds_points(df, "label").collect()}
    for g, v in groups.items():
        want = classify.classical_mds(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)))
        assert np.allclose([got[100 * g + i] for i in range(len(v))], want, atol=1e-6)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_mds_takes_no_distances(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(classify, "grouped_points", lambda *a: taken.append(a))
    assert registry.QUERIES["mds_embedding"](spark, SF).count() > 0 and not taken


def test_common_neighbours_meet_as_bits(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SETS", 16)
    monkeypatch.setattr(blocks, "TOKENS", 8)
    monkeypatch.setattr(blocks, "LEAVING", 50)
    r = np.random.default_rng(4)
    e = {(f"c{i}", f"s{j}") for i in range(70) for j in range(30) if r.random() < 0.15}
    edges = spark.createDataFrame(sorted(e), "src string, dst string").withColumn("eid", F.concat("src", "dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    to, back = {}, {}
    for a, b in e:
        to.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)
    want = sorted((a, b) for m in (to, back) for a in m for b in m if m[a] & m[b])
    monkeypatch.setattr(blocks, "block_pairs", None)  # no products
    assert sorted(map(tuple, Graph(nodes, edges).neighbours().collect())) == want


def test_ncd_counts_equal_sets_once(spark, monkeypatch):
    monkeypatch.setattr(patterns, "overlaps", None)  # no list of pairs by token
    rows = spark.range(60).select(F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), 2 + F.col("id") % 3)).alias("token"))
    got = {(r.a, r.b): r.ncd for r in patterns.ncd_pairs(rows, "conv_id", "token", digits=6).collect()}
    size = lambda k: 3 + k % 3
    assert got == {(a, b): round(1 - min(size(a), size(b)) / max(size(a), size(b)), 6) for a in range(60) for b in range(a + 1, 60)}


def test_vectors_are_sent_once_to_a_small_group(spark, monkeypatch):
    """And as floats, if they are: 6,000 of a group went three times, as doubles."""
    sent, whole = [], align.meeting_parts
    monkeypatch.setattr(align, "meeting_parts", lambda v, *a: sent.append((v.agg(F.max("parts")).first()[0], v.schema["v"].dataType.simpleString())) or whole(v, *a))
    v = spark.range(6000).select("id", F.lit(1).alias("label"), F.array(F.rand(1).cast("float"), F.rand(2).cast("float")).alias("v"))
    align.cosine_pairs(v, "id", "v", "label")
    assert sent == [(1, "array<float>")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no data")
def test_nearest_neighbor_rate_asks_for_every_vector(spark):
    n = registry.QUERIES["nearest_neighbor_rate"](spark, SF).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{SF}/embeddings.parquet").count()
