"""Repeated windows by recompression against a plain version."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from braidline.llm import recompression

DOCS = "doc_id long, text string, lang string, _id long, name long, at int, text_ string"


def plain(rows, k):
    """(id, n_words, n_removed, kept_sha256) of every row."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    place = lambda i: (i is None, i or 0)
    first = {}
    for i, w in words:
        for s in range(len(w) - k + 1):
            first.setdefault(tuple(w[s : s + k]), place(i))
            first[tuple(w[s : s + k])] = min(first[tuple(w[s : s + k])], place(i))
    out = collections.Counter()
    for i, w in words:
        gone, own = set(), set()
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if first[key] < place(i) or key in own:
                gone.update(range(s, s + k))
            own.add(key)
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", 1, 2, 3, "x") for k, t in rows], DOCS)


def made_rows(seed, n=60):
    """Texts with whole copies, shared passages, runs, and edits."""
    rnd = random.Random(seed)
    say = lambda n, v=400: [f"w{rnd.randint(0, v)}" for _ in range(n)]
    passages = [say(rnd.randint(15, 70)) for _ in range(6)] + [["ha"] * 45, ["ab", "cd"] * 30, ["x"] * 21 + ["y"] * 25]
    texts = []
    for _ in range(n):
        w = say(rnd.randint(0, 80))
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)
        if texts and rnd.random() < 0.4:
            w = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 2)):
                if w:
                    w[rnd.randrange(len(w))] = "edited"
        texts.append(w)
    ids = rnd.sample(range(1000), n)
    return [(i, rnd.choice([" ", "\t", " \n\x0b "]).join(w)) for i, w in zip(ids, texts)]


@pytest.mark.parametrize("seed,window", [(1, 20), (2, 20), (3, 5), (4, 2), (5, 1)])
def test_made_texts(spark, seed, window):
    rows = made_rows(seed)
    assert collections.Counter(map(tuple, recompression.substring_dedup(frame(spark, rows), window=window).collect())) == plain(rows, window)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 977}" for i in range(5000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, long), (6, "é\x1c " + long + " end"), (7, "a " * 3000), (8, "b" * 9000 + " " + long), (8, long), (8, "c " * 19), (9, "b" * 9000), (None, long), (None, "own " * 30), (0, " ".join(long.split()[:50]))]
    got = collections.Counter(map(tuple, recompression.substring_dedup(frame(spark, rows).repartition(3)).collect()))
    assert got == plain(rows, 20)
    assert recompression.substring_dedup(frame(spark, [])).collect() == []


def test_pieces_and_stretches(spark, monkeypatch):
    """Neither where long texts are cut nor how many words are parsed at once tells."""
    rows = made_rows(7, 30) + [(2000, " ".join(t for _, t in made_rows(8, 30))), (2001, "q" * 700 + " " + "r" * 90)]
    hashes = recompression.word_hashes(rows[-1][1].encode()), recompression.word_hashes(rows[-2][1].encode())
    for name, value in (("STRETCH", 64), ("LONG_WORD", 60), ("PIECE", 100), ("AT_ONCE", 300)):
        monkeypatch.setattr(recompression, name, value)
    assert recompression.word_hashes(rows[-1][1].encode()).shape == hashes[0].shape
    parses = lambda: sum(len(p.starts) for p, _, _ in recompression._parses([(0, recompression.word_hashes(rows[-2][1].encode()))], 20))
    assert parses() == hashes[1].shape[1] - 19
    # tasks see the patched values only where they run in this process, so parse here
    found, own, again = collections.defaultdict(set), recompression._Own(), collections.Counter()
    for p, who, base in recompression._parses(((i, recompression.word_hashes((t or "").encode())) for i, (_, t) in enumerate(rows)), 20):
        one, two = p.window_digests(np.arange(len(p.starts)))
        piece = p.piece[p.starts]
        row, at = who[piece], p.starts - p.first[piece] + base[piece]
        for x in zip(one.tolist(), two.tolist(), p.anchor.tolist()):
            found[x[:2]].add(x[2])
        again.update(row[own.again(row, one, two, at)].tolist())
    assert all(len(g) == 1 for g in found.values())  # equal windows choose alike
    for i, (_, t) in enumerate(rows):
        w = (t or "").split()
        inner = [tuple(w[s : s + 20]) for s in range(len(w) - 19)]
        assert again[i] == len(inner) - len(set(inner))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=6), st.integers(2, 9))
def test_equal_windows_choose_one_symbol(texts, window):
    """... at one distance, and high-level symbols of one name stand for equal words."""
    hashed = [recompression.word_hashes(" ".join(t).encode()) for t in texts]
    flat, chosen, high = [], {}, {}
    for p, who, base in recompression._parses(enumerate(hashed), window):
        words = [w for i in who for w in texts[i]]
        for s, name, at in zip(p.starts.tolist(), p.anchor.tolist(), p.anchor_at.tolist()):
            assert chosen.setdefault(tuple(words[s : s + window]), (name, at - s)) == (name, at - s)
        for name, at, n in zip(p.high.tolist(), p.high_at.tolist(), p.high_size.tolist()):
            assert n >= window and high.setdefault(name, words[at : at + n]) == words[at : at + n]
        flat += words
    assert len(chosen) == len({tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1)})


def test_high_symbols_cover_copies():
    """A long text is one symbol in the end, and so is each copy of it."""
    rnd = random.Random(1)
    text = " ".join(str(rnd.randint(0, 99)) for _ in range(700)).encode()
    (p, _, _), = recompression._parses(enumerate([recompression.word_hashes(text)] * 2), 20)
    whole = p.high_size == 700
    assert whole.sum() == 2 and len(set(p.high[whole].tolist())) == 1
