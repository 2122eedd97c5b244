"""op6: what recurs is counted exactly and over different sets, whatever the table's size."""

import random

import numpy as np

from braidline.llm import jaccard
from test_corpus_operators import brute_links


def own(rnd, n):
    return [f"w{rnd.randrange(10**9)}" for _ in range(n)]


def test_copies_in_other_tasks_do_not_make_passages_meet(spark, monkeypatch):
    rnd = random.Random(5)
    passage = own(rnd, 60)
    texts = [" ".join(own(rnd, 60) + passage) for _ in range(40)]
    rows = [(k * 40 + i, t) for k in range(4) for i, t in enumerate(texts)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    met = []
    whole = jaccard.connected_components
    monkeypatch.setattr(jaccard, "connected_components", lambda e, **k: met.append(e.count()) or whole(e, **k))
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: i % 40 for i, _ in rows}
    assert met == [0]


def test_heavy_keys_over_stretches(spark):
    rnd = random.Random(6)
    base, rows = own(rnd, 80), []
    for i in range(120):
        w = list(base) if i % 2 else own(rnd, 40) + base[:50]
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = own(rnd, 1)[0]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 5), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, shard_docs=25).collect()}
    assert got == brute_links(rows)


def test_packed_numbers():
    for x in ([], [0], [0, 255, 256, (1 << 55) - 1], list(range(1000))):
        assert jaccard.unpacked(jaccard.packed(np.array(x, "i8"))).tolist() == x
