"""Importance resampling against a plain version, and the tries themselves."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from braidline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, _id long, _row long, rank int, n string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, percent, least, buckets, longest, seed):
    """(id, n_features, weight, score, rank) of every row."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in runs(x, longest)) for texts in ([x for _, x in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for k, x in docs:
        f = runs(x, longest)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        h = None if k is None else int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16)
        score = None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([k, len(f), weight, score, None])
    part = sorted((r for r, (k, x) in zip(out, docs) if k is not None and len(words(x)) >= least), key=lambda r: (-r[3], r[0]))
    for i, r in enumerate(part[: percent * len(part) // 100], 1):
        r[4] = i
    return Counter(map(tuple, out))


def frame(spark, rows):
    return spark.createDataFrame([(k, x, "en", 1, 2, 3, "n") for k, x in rows], DOCS)


def some_rows():
    rnd = random.Random(4)
    made = ["Alpha", "BETA9", "gamma", "naïve", "ÉTÉ", "x2", "日本", "rare", "often"]
    rows = [(i, " ".join(rnd.choice(made) for _ in range(rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "- _ ."), (203, "often " * 5000), (204, "z" * 3000 + " " + "é" * 2000 + " a" * 30), (205, rows[3][1]), (None, rows[4][1]), (None, None)]
    return rows


TARGET = ["rare rare naïve 日本", "x2 " * 40, None, "", "z" * 3000]


@pytest.mark.parametrize("percent,longest,buckets", [(10, 1, 10_000), (35, 2, 50), (100, 1, 7), (0, 1, 100)])
def test_resample(spark, percent, longest, buckets):
    target = spark.createDataFrame([(i, x) for i, x in enumerate(TARGET)], "item_id long, text string")
    got = resampling.resample(frame(spark, some_rows()).repartition(5), target, percent=percent, longest=longest, buckets=buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(some_rows(), TARGET, percent, 20, buckets, longest, 2024)


def test_ties_and_repeats(spark):
    """Rows that share an id tie with themselves: any of them, but as many as are drawn."""
    rows = [(k, "word " * 25) for k in [5] * 6 + [3] * 6 + [9]]
    target = spark.createDataFrame([("word",)], "text string")
    got = resampling.resample(frame(spark, rows), target, percent=50).collect()
    want = plain(rows, ["word"], 50, 20, 10_000, 1, 2024)
    assert Counter(map(tuple, got)) == want and sorted(r.rank for r in got if r.rank) == list(range(1, 7))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(frame(spark, []), none).collect() == []
    assert Counter(map(tuple, resampling.resample(frame(spark, some_rows()), none).collect())) == plain(some_rows(), [], 10, 20, 10_000, 1, 2024)


@pytest.mark.parametrize("most", [3, 40, 100_000])
def test_trie(most):
    """Counts and gains do not hang on when the trie is emptied, nor on where it splits."""
    rnd = random.Random(most)
    seen = Counter("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))).encode() * rnd.choice([1, 1, 20]) for _ in range(400))
    trie = resampling.WordTrie(64, most=most)
    for f, n in seen.items():
        trie.add(Counter({f: n}))
        trie.add(Counter({f: 1}))
    trie.empty()
    want = Counter()
    for f, n in seen.items():
        want[zlib.crc32(f) % 64] += n + 1
    assert trie.totals.tolist() == [want[b] for b in range(64)]
    gains = [rnd.randint(-99, 99) for _ in range(64)]
    trie = resampling.WordTrie(64, gains, most=most)
    assert all(trie.gain(f) == gains[zlib.crc32(f) % 64] for f in [*seen, *seen])


def test_ranked_over_ranges(spark):
    """Ranks run on from range to range, by a sort in ranges and no single task."""
    rows = spark.range(0, 5000, 1, 7).select("id", (F.col("id") * 7919 % 1000).alias("v"))
    got = {r.id: r.place for r in resampling.ranked(rows, [F.desc("v"), F.asc("id")], "place").collect()}
    order = sorted(range(5000), key=lambda i: (-(i * 7919 % 1000), i))
    assert got == {k: i for i, k in enumerate(order, 1)}
