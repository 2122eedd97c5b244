"""Pair joins: keys whose sets are equal meet as one, and their pairs are made where they leave."""

import random

import pytest
from pyspark.sql import functions as F

from braidline.operators import blocks, patterns


def keyed(spark, sets):
    return spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "pid long, token long")


@pytest.fixture(params=[3, 500])
def sets(request):
    """Many keys on few sets: crowded with few tokens, else meeting by rare tokens."""
    rnd, made = random.Random(request.param), {}
    shapes = [frozenset(rnd.sample(range(request.param + 4), 4)) for _ in range(30)]
    shapes += [s | {1000 + i} for i, s in enumerate(shapes[:6])] + [s - {min(s)} for s in shapes[6:12]]
    return {k: rnd.choice(shapes) for k in range(160)}


def test_every_pair_of_keys(spark, sets, monkeypatch):
    monkeypatch.setattr(patterns, "PART", 3)
    rows, keys = keyed(spark, sets), sorted(sets)
    twos = [(a, b, sets[a], sets[b]) for a in keys for b in keys if a < b and sets[a] & sets[b]]
    got = lambda df: sorted(tuple(r) for r in df.collect())
    j = [(a, b, round(len(x & y) / len(x | y), 6)) for a, b, x, y in twos if len(x & y) / len(x | y) >= 0.6]
    assert got(patterns.jaccard_pairs(rows, "pid", "token", 0.6, digits=6)) == sorted(j)
    d = [(a, b, round(2 * len(x & y) / (len(x) + len(y)), 6)) for a, b, x, y in twos if 2 * len(x & y) / (len(x) + len(y)) >= 0.75]
    assert got(patterns.dice_pairs(rows, "pid", "token", 0.75, digits=6)) == sorted(d)
    assert got(patterns.same_but_n(rows, "pid", "token", 1)) == sorted((a, b, len(x ^ y)) for a, b, x, y in twos if len(x ^ y) <= 1)
    assert got(patterns.subset_pairs(rows, "pid", "token")) == sorted([(a, b) for a, b, x, y in twos if x < y] + [(b, a) for a, b, x, y in twos if y < x])


def test_null_tokens_count_in_the_size_alone(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (2, None), (3, 5), (3, 6), (None, 5), (4, None)], "pid long, token long")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(patterns.same_but_n(rows, "pid", "token", 1)) == [(1, 2, 1), (1, 3, 0), (2, 3, 1)]
    assert got(patterns.subset_pairs(rows, "pid", "token")) == [(1, 2), (3, 2)]


def test_sets_are_multiplied_once_for_all_their_keys(spark, monkeypatch):
    """400 keys on two sets: two rows meet, not 400."""
    met = []
    whole = blocks._dealt
    monkeypatch.setattr(blocks, "_dealt", lambda rows, *a: met.append(rows.count()) or whole(rows, *a))
    rows = spark.range(400).select(F.col("id").alias("pid"), F.explode(F.sequence(F.lit(0), 3 + F.col("id") % 2)).alias("token"))
    assert patterns.jaccard_pairs(rows, "pid", "token", 0.8).count() == 400 * 399 // 2
    assert met == [2]
