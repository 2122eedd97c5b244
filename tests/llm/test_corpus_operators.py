"""The corpus operators against brute force, round trips and odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from braidline.llm import byte_bpe, exact_dedup, jaccard, language, lattice_lm, neighbours, packing, token_files, tokens, toxicity, warc

WORDS = "the of and to in that is was for with on as at by it from or an be this".split()
DOCS = "doc_id long, text string, lang string, _id long, _slot int, id string"


def docs(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(k, t, "en", 1, 2, "x") for k, t in rows], DOCS)


ODD = [(1, "A  b\tc"), (2, "A b c"), (3, None), (4, ""), (5, "é È\x0b x"), (6, "A b c"), (None, "A b c"), (None, "lone"), (7, "word " * 3000), (8, "x" * 6000), (8, "again, 8"), (9, " \n ")]


def squeeze(x):
    out = "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in x or "")
    while "  " in out:
        out = out.replace("  ", " ")
    return out


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(docs(spark, ODD), bits=4).collect()
    groups = collections.defaultdict(list)
    for k, t in ODD:
        groups[squeeze(t)].append(k)
    want = collections.Counter()
    for k, t in ODD:
        ids = [x for x in groups[squeeze(t)] if x is not None]
        keep = min(ids) if ids else None
        want[(k, keep, len(groups[squeeze(t)]), k is not None and k == keep, hashlib.sha256(squeeze(t).encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_sorted_runs(spark):
    """Runs are sorted, whole and merged round by round in the plan that is executed."""
    rnd = random.Random(3)
    rows = [(i, f"text {rnd.randint(0, 300)}") for i in range(2000)]
    base = spark.createDataFrame(rows, "_id long, text string").repartition(16)
    base = base.select("_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check"), F.spark_partition_id().alias("slot"))
    base = exact_dedup.materialise(base, "test-runs")
    final, first = exact_dedup.tree_merge(base, bits=4, step=2, run_rows=500)
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[hashlib.sha256(t.encode()).digest()].append(k)
    for r in first.collect():
        assert [x.digest for x in r.run] == sorted({bytes(x.digest) for x in r.run})
    got = [x for r in sorted(final.collect(), key=lambda r: r.range) for x in r.run]
    assert [(bytes(x.digest), x.keep_id, x.n) for x in got] == [(d, min(k), len(k)) for d, k in sorted(groups.items())]
    assert first.count() > final.count() == 4
    # the physical plan's text leaves an aggregate's results out; the optimised one has them
    plan = final._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("sort_array(flatten(collect_list(run") == 2
    assert plan.executedPlan().toString().count("partial_collect_list(run") >= 2


def segmentations(model, word):
    """(log probability, uses) of every path through a word's lattice; a use is a piece's
    number and whether it begins the word, or a byte."""
    text, out, number = lattice_lm.MARK + word, [], {p: i for i, p in enumerate(model.pieces)}

    def go(i, lp, uses):
        if i == len(text):
            out.append((lp + model.stop, uses))
            return
        lp += model.go if i else 0
        for j in range(i + 1, len(text) + 1):
            k = number.get(text[i:j])
            w = -math.inf if k is None else float((model.follow if i else model.begin)[k])
            if w > -math.inf:
                go(j, lp + w, [*uses, (k, not i)])
        if i:
            raw = text[i].encode()
            go(i + 1, lp + sum(float(model.bytes[b]) for b in raw) + model.go * (len(raw) - 1), [*uses, *((b, None) for b in raw)])

    go(0, 0.0, [])
    return out


def brute_lattice(model, word):
    out = [lp for lp, _ in segmentations(model, word)]
    top = max(out)
    return top + math.log(sum(math.exp(x - top) for x in out))


def test_lattice():
    words = ["a", "the", "tion", "ñé", "xqzj", "日", "walking", "a", "▁a", "thethe", "é"]
    model = lattice_lm.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.allclose(model.log_probabilities(words), [brute_lattice(model, w) for w in words], rtol=1e-9)
    times = [3, 1, 2, 1, 5, 1, 1, 2, 1, 1, 4]
    want = [np.zeros(len(model.pieces)), np.zeros(len(model.pieces)), np.zeros(256)]
    for w, n in zip(words, times):
        whole = brute_lattice(model, w)
        for lp, uses in segmentations(model, w):
            for k, begins in uses:
                want[2 if begins is None else 0 if begins else 1][k] += n * math.exp(lp - whole)
    got = model.expected(words, times)
    assert all(np.allclose(x, y, atol=1e-9) for x, y in zip(got, want))
    fitted = model.adapted(*got, sum(times))
    assert (fitted.log_probabilities(words) @ times) > (model.log_probabilities(words) @ times)
    assert math.isclose(np.exp(fitted.begin).sum(), 1, rel_tol=1e-9)
    assert math.isclose(np.exp(fitted.follow).sum() + np.exp(fitted.bytes).sum(), 1, rel_tol=1e-9)


def test_document_score_by_segmentation(spark):
    """A document's score against all segmentations of its words under a lattice trained here."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(1, "the cat sat"), (2, "The walking cat"), (3, "a cat a mat"), (10, "unseen words ñ the"), (10, "the"), (20, None), (30, "  \n")]
    got = collections.defaultdict(set)
    for r in lattice_lm.score_documents(docs(spark, rows), F.col("doc_id") % 10 == 0, path, rounds=2).collect():
        got[r.doc_id].add(round(r.score, 9))
    cut = {(k, t): (t or "").lower().split() for k, t in rows}
    train = collections.Counter(w for (k, _), ws in cut.items() if k % 10 for w in ws)
    model = prior = lattice_lm.Lattice(path)
    for _ in range(2):
        model = prior.adapted(*model.expected(list(train), list(train.values())), sum(train.values()))
    rate = (3 + 1) / (sum(train.values()) + 3 + 2)
    for (k, t), ws in cut.items():
        want = sum(brute_lattice(model, w) + math.log(1 - rate) for w in ws) + math.log(rate)
        assert any(abs(want / math.log(10) - x) < 1e-6 for x in got[k])


def test_lattice_scores(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(WORDS) for _ in range(40))) for i in range(60)] + [(100, None), (101, "NEVERseen " * 3), (None, "of")]
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False))
    got = lattice_lm.score_documents(docs(spark, rows), held, public_tokenizers.path("piece_bpe_32k.model")).collect()
    cut = {k: (t or "").lower().split() + [" "] for k, t in rows}
    c = collections.Counter(w for k, ws in cut.items() if not (k is not None and k % 5 == 0) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        ws = cut[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0 and r.counted_score < 0
    assert lattice_lm.score_documents(docs(spark, []), held, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def odd_texts(n=400):
    rnd, pool = random.Random(5), "aZ éß \t\n.,'s'd 12 ²Σς  　\x1c\x85 日本 <|endoftext|> 😀ı  -?!"
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 50))) for _ in range(n)] + ["x" * 5000, "ab" * 3000, "", None, "Hello  world\n\n I'll"] + [
        "a\n \nb", "a \n \n b", " a", "a ", "\n a b", "a b\n c", "it's 'so' it 's", "a\x1cb\x1f c", "\x85 a \x85 b", "x \t y", "end \n"]


@pytest.mark.parametrize("long_bytes", [1, 6, 512])
def test_byte_bpe(spark, long_bytes):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    letters = random.Random(7)
    texts = odd_texts(60 if long_bytes < 512 else 400) + ["aa" * 400 + "a", "".join(letters.choice("thein ")[0].strip() or "e" for _ in range(3000))]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = collections.defaultdict(set)
    for r in byte_bpe.encode(docs(spark, rows), path, public_tokenizers.PATTERN, long_bytes=long_bytes).collect():
        got[r.doc_id].add((bytes(r.ids), bytes(r.decoded)))
    for k, t in rows:
        assert got[k] == {(np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode())}
    assert byte_bpe.digests(docs(spark, []), path, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_very_long_piece(spark):
    """One piece of 40,000 letters folds like any other."""
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(3)
    text = "".join(rnd.choice("etaoinshrdlu") for _ in range(40_000))
    got = byte_bpe.encode(docs(spark, [(1, text)]), path, public_tokenizers.PATTERN).first()
    assert bytes(got.ids) == np.array(own.encode_ordinary(text), "<u4").tobytes() and bytes(got.decoded) == text.encode()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piece_encoder(name):
    e = tokens.PieceEncoder(public_tokenizers.path(name))
    texts = [t or "" for t in odd_texts()]
    assert e.encode(texts) == [np.array(x.ids, e.dtype).tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_toxicity_pairs():
    rnd, rows = random.Random(2), []
    for i in range(900):
        words = rnd.sample(WORDS, 6)
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words += ["insultx"] * a + ["groupy"] * b
        rows.append((np.unique(np.array([h for w in words for h in toxicity.hashes(w)], "<u4")).tobytes(), int(a and b), " ".join(words)))
    model = toxicity.fit([r[:2] for r in rows[:700]])
    right = [(s >= 0.5) == bool(y) for s, (_, y, _) in zip(model.score([r[2] for r in rows[700:]]), rows[700:])]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= s <= 1 for s in model.score([None, "", "x" * 10000]))
    assert toxicity.fit([]).score(["a"]) [0] < 0.5


def term_rows(texts):
    return [np.unique(np.array([h for t in toxicity.terms(x) for h in toxicity.hashes(t)], "<u4")).tobytes() for x in texts]


def test_toxicity_exclusive_or():
    """Two terms that are neutral alone tell together."""
    rnd, texts, y = random.Random(2), [], []
    for _ in range(2500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(rnd.sample(WORDS, 6) + ["insultx"] * a + ["groupy"] * b))
        y.append(int(a != b))
    model = toxicity.fit(list(zip(term_rows(texts), y))[:2000])
    assert not len(toxicity.informative([(np.frombuffer(h, "<u4"), v) for h, v in zip(term_rows(texts), y)], np.array(y, "f4"), 3))
    got = [s >= 0.5 for s in model.score(texts[2000:])]
    assert np.mean(np.array(got) == (np.array(y[2000:]) == 1)) > 0.97


def test_toxicity_score_is_the_pair_sum():
    """The score against weights and factors summed pair by pair."""
    rng = np.random.default_rng(3)
    h = np.unique(np.array([x for w in WORDS for x in toxicity.hashes(w)], "u4"))
    m = toxicity.Machine(h, rng.normal(0, 0.3, len(h)).astype("f4"), rng.normal(0, 0.3, (len(h), 4)).astype("f4"), -0.2)
    for text in ("", None, "the of The", "that with this IS an", " ".join(WORDS)):
        at = [i for i, x in enumerate(h.tolist()) if x in {k for t in toxicity.terms(text) for k in toxicity.hashes(t)}]
        margin = m.bias + sum(float(m.weights[i]) for i in at)
        margin += sum(float(m.factors[i].astype("f8") @ m.factors[j].astype("f8")) for n, i in enumerate(at) for j in at[:n])
        assert abs(m.score([text])[0] - 1 / (1 + math.exp(-margin))) < 1e-6


def test_pair_screen_rounds():
    """The pairs found do not hang on how many are counted at once."""
    rnd = random.Random(5)
    texts, y = [], []
    for _ in range(600):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        texts.append(" ".join(rnd.sample(WORDS, 8) + ["left"] * a + ["right"] * b))
        y.append(int(a and b) if rnd.random() < 0.9 else 0)
    rows, y = [(np.frombuffer(h, "<u4"), v) for h, v in zip(term_rows(texts), y)], np.array(y, "f4")
    one = toxicity.telling_pairs(rows, y, 10)
    assert {toxicity.hashes("left")[0], toxicity.hashes("right")[0]} <= set(one.tolist())
    assert toxicity.telling_pairs(rows, y, 10, cells_at_once=500).tolist() == one.tolist()


def test_pair_screen_of_long_rows():
    """A pair is found in rows of some hundred candidate terms, all of which take part."""
    rnd = random.Random(8)
    texts, y = [], []
    for i in range(400):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rest = [f"filler{j}" for j in rnd.sample(range(700), 350)]
        texts.append(" ".join(rest + ["left"] * a + ["right"] * b))
        y.append(int(a and b))
    rows, y = [(np.frombuffer(h, "<u4"), v) for h, v in zip(term_rows(texts), y)], np.array(y, "f4")
    found = set(toxicity.telling_pairs(rows, y, 10).tolist())
    assert {toxicity.hashes("left")[0], toxicity.hashes("right")[0]} <= found
    for p, q, m in ((0, 4, 5), (1, 3, 6), (2, 2, 4)):
        assert list(zip(*(v.tolist() for v in toxicity._pairs(p, q, m)))) == [(a, b) for a in range(p, q) for b in range(a + 1, m)]


def test_toxicity_frames(spark):
    d = docs(spark, [(i, "bad apple" if i % 2 else "good pear") for i in range(60)] + [(None, "bad"), (70, None)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels, F.lit(True))
    got = {r.doc_id: r.s for r in d.select("doc_id", toxicity.score(model, F.col("text")).alias("s")).collect()}
    assert got[1] > 0.5 > got[2] and 0 <= got[70] <= 1
    assert toxicity.train(d.limit(0), labels.limit(0), F.lit(True)).bias < 0
    # repeated ids train once, whatever their number; long texts and clashing names do no harm
    again = docs(spark, [(5, f"bad apple {i}") for i in range(50)] + [(i, "bad apple" if i % 2 else "good pear") for i in range(6, 60)] + [(2, "word " * 20_000)])
    twice = toxicity.train(again, labels.unionByName(labels), F.lit(True))
    got = [r.s for r in again.select(toxicity.score(twice, F.col("text")).alias("s")).collect()]
    assert len(got) == 105 and all(0 <= s <= 1 for s in got) and got[0] > 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_pack_values(values):
    control, data = token_files.pack(np.array(values, "<u4"))
    assert token_files.unpack(control, data, len(values)).tolist() == values


def test_token_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(k, t) for k, t in enumerate(odd_texts(50))][::-1] + [(None, "null id"), (7, "again"), (-(1 << 63), "least id"), (None, "")] + [(9, "hot id")] * 40
    folder, manifest = token_files.write_token_files(docs(spark, rows), path, end_id=2)
    got = token_files.read_token_files(spark, folder, manifest).collect()
    e = tokens.PieceEncoder(path)
    want = collections.Counter((k, np.append(np.frombuffer(e.encode([t or ""])[0], e.dtype), 2).astype("<u4").tobytes()) for k, t in rows)
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2] == -(1 << 63) and ids[2:] == sorted(ids[2:])
    folder, manifest = token_files.write_token_files(docs(spark, []), path, end_id=2)
    assert token_files.read_token_files(spark, folder, manifest).count() == 0


def test_warc(spark):
    big = "<p>é" + "z" * 1500
    rows = [(1, "u1", big), (2, "u\n2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "u", "y" * 70000)]
    rows += [(100 + i, "u", f"{random.Random(i).random()} " * 200) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_archives(pages)
    for split in (200, 5000, 1 << 20):
        got = {r.page_id: r for r in warc.read_archives(manifest, split_bytes=split).collect()}
        assert len(got) == len(rows)
        for k, _, html in rows:
            raw = (html or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            if got[k].record_type == "response":
                assert bytes(got[k].payload) == raw
        assert {k for k, r in got.items() if r.record_type == "revisit"} == {1, None} and got[1].refers_to == 2
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    # repeated ids, many empty pages, many equal long ones, clashing names
    rows = [(1, "u", "")] * 50 + [(2, "u", big)] * 3 + [(3, "u", big + "x"), (4, None, big), (None, "u", None)]
    odd = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, salt int, digest string, kept int").repartition(4)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(odd)).collect())
    n = len(big.encode())
    assert got == {(1, 0, "response", None): 50, (2, n, "revisit", 4): 3, (3, n + 1, "response", None): 1, (4, n, "response", None): 1, (None, 0, "response", None): 1}


def test_warc_large_copies(spark):
    """The way for tables whose repeated payloads are too many to be sent whole."""
    rows = [(i, "u", f"page {i % 7} " * 200) for i in range(60)] + [(100 + i, "u", f"pair {i // 2} " * 200) for i in range(8)] + [(200, "u", None), (201, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    both = [sorted(tuple(r) for r in warc.read_archives(warc.write_archives(pages, sent_rows=n), with_payload=False).collect()) for n in (0, 500_000)]
    was = warc.HOT_SHARES
    try:
        warc.HOT_SHARES = 20  # groups of more than four rows are sent, pairs meet by digest
        both.append(sorted(tuple(r) for r in warc.read_archives(warc.write_archives(pages, sent_rows=0), with_payload=False).collect()))
    finally:
        warc.HOT_SHARES = was
    assert both[0] == both[1] == both[2]
    assert {r[0]: r[5] for r in both[0]} == {i: (53 + (i - 53) % 7 if i < 53 else None) for i in range(60)} | {100 + i: (None if i % 2 else 101 + i) for i in range(8)} | {200: None, 201: None}


class Counted:
    """An open file that counts the bytes read of it."""

    def __init__(self, data):
        self.data, self.at, self.n = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, most):
        got = self.data[self.at : self.at + most]
        self.at += len(got)
        self.n += len(got)
        return got


def test_warc_reads_forward():
    """Bytes read: the file once, and a tail a range; headers of any length are found."""
    rnd = random.Random(9)
    sizes = [rnd.choice([10, 200, 5000]) for _ in range(6000)] + [700_000]
    uris = ["u" * (400_000 if i == 3000 else 5) + rnd.randbytes(8).hex() for i in range(len(sizes))]
    # headers that do not compress, so that one is longer than a read
    uris[4500] = rnd.randbytes(300_000).hex()
    members = [warc.gzip_member(warc.record("response", i, uris[i], "d", rnd.randbytes(n), n, "00" * 20)) for i, n in enumerate(sizes)]
    data, starts = b"".join(members), np.cumsum([0] + [len(m) for m in members]).tolist()
    split, found, read = 1 << 20, [], 0
    for start in range(0, len(data), split):
        f = Counted(data)
        m = warc._Members(f, len(data))
        end = min(start + split, len(data))
        at = m.first(start, end)
        while at is not None and at < end:
            found.append(at)
            at = m.decode(at)[1]
        read += f.n
    assert found == starts[:-1]
    ranges = -(-len(data) // split)
    assert read <= 1.2 * len(data) + ranges * 2 * warc.READ, (read, len(data))


def brute_links(rows, num=80, den=100):
    sets = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("shard", [3, 1000])
def test_jaccard(spark, shard):
    rnd, rows = random.Random(3), []
    base = [[rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "edit" + str(rnd.randint(0, 9))
        rows.append((i, (" \n" if i % 2 else " ").join(w).upper() if i % 3 else " ".join(w)))
    rows += [(200, None), (201, ""), (202, "one two"), (203, "ONE  two"), (204, "five words are just enough"), (205, rows[0][1]), (206, "w " * 2000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows + [(None, "five words are just enough")]), shard_docs=shard).collect()}
    assert got.pop(None) == (1, None)
    assert got == brute_links(rows)
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_searcher_against_brute():
    rnd = random.Random(9)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 40))), "i8") for _ in range(80)]
    index = jaccard.Searcher(sets, 6, 10)
    for q in sets[:30]:
        want = [i for i, s in enumerate(sets) if 10 * len(set(q) & set(s)) >= 6 * len(set(q) | set(s))]
        assert sorted(index.search(q)) == want


def fewest_bins(lengths, capacity):
    """The optimum, by trying every bin for every item."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= lengths[i] and rooms[j] not in rooms[:j]:
                go(i + 1, rooms[:j] + [rooms[j] - lengths[i]] + rooms[j + 1 :])
        go(i + 1, rooms + [capacity - lengths[i]])

    go(0, [])
    return best


def test_packing_against_optimum():
    rnd, exact = random.Random(4), 0
    for _ in range(150):
        lengths = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 9))]
        bins = packing.Search(packing.arrival_fill(lengths, 30), lengths, 30).run()
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 30 for b in bins)
        best = fewest_bins(lengths, 30)
        assert best <= len(bins) <= best + 1
        exact += len(bins) == best
    assert exact >= 140


def test_packing_steps():
    """The search packs: from arrival order down to the floor, by each kind of step."""
    rnd = random.Random(4)
    lengths = [rnd.randint(1, 4096) for _ in range(1500)] + [rnd.randint(1, 300) for _ in range(1500)]
    rnd.shuffle(lengths)
    start = packing.arrival_fill(lengths, 4096)
    search = packing.Search(start, lengths, 4096)
    before = sum(int(f) ** 2 for f in search.fill)
    bins = search.run()
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in bins) and sum(int(f) ** 2 for f in search.fill) > before
    assert len(start) > 1.2 * len(bins) and len(bins) <= 1.03 * -(-sum(lengths) // 4096)
    assert search.steps["move"] > 100 and search.steps["one for one"] > 100 and search.steps["two for one"] > 10
    # lengths as documents have them: the floor itself is reached
    lengths = [min(4096, int(rnd.lognormvariate(6, 1.2)) + 1) for _ in range(4096)]
    start = packing.arrival_fill(lengths, 4096)
    assert len(packing.Search(start, lengths, 4096).run()) == -(-sum(lengths) // 4096) < 0.9 * len(start)
    # only trading one for two, or two for one, puts tokens into the fuller bin here
    for bins, lengths in (([[0], [1, 2, 3]], [7, 3, 3, 2]), ([[0, 1], [2, 3]], [3, 3, 5, 3])):
        two = packing.Search(bins, lengths, 9)
        assert two._step(0) and two.steps == {"two for one": 1}


def test_packing_rounds(spark):
    """The groups' rests meet, so that the whole table comes near its floor."""
    rnd = random.Random(6)
    rows = [(i, 0, rnd.randint(1, 300)) for i in range(20_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    out = packing.pack(pieces, capacity=1000, group_items=250).collect()
    fill = collections.Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert sorted((r.doc_id, r.length) for r in out) == sorted((a, c) for a, _, c in rows) and max(fill.values()) <= 1000
    assert len(fill) <= 1.002 * sum(c for _, _, c in rows) / 1000 + 1  # 80 groups, two rounds


def test_packing(spark):
    rows = [(k, t) for k, t in enumerate(odd_texts(60))] + [(None, "null id"), (3, "again"), (500, "word " * 9000)]
    out = packing.pack_documents(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=512).collect()
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= 512
    e = tokens.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = np.append(np.frombuffer(e.encode(["word " * 9000])[0], e.dtype), 1).astype("<u4")
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == 500)
    assert mine == [(i, 512 * i, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(np.split(ids, range(512, len(ids), 512)))]
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype("f4")
    x[100:160] = x[100]  # a common vector
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [None] * 16, 0), (1080, [1.0, 2.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("_id") % 20 == 0, block_rows=100).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    y = x.astype("f8")
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = set(np.lexsort((np.arange(600), -s))[:20].tolist())
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(score - s[v]) < 1e-9 for _, v, score in found)
        hits += len(want & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    # an id with several vectors is a row each, and equal vectors tie by id
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert {r.vec_id for r in neighbours.nearest(twice, F.col("_id") % 20 == 0).collect()} == {1, 2}
    few = neighbours.nearest(df.where("vec_id < 5"), F.col("_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(df.limit(0), F.col("_id") % 20 == 0).count() == 0


def test_neighbours_fit_reaches_its_target():
    """No slot of up to twice the spread has enough visits for this target; wider ones do."""
    x = np.random.default_rng(3).normal(size=(300, 32))
    h = neighbours.fit(x, 300, float(np.sqrt((x * x).sum(1)).max()), k=20, tables=1, width=6, target=0.9999, queries=100)
    s = x[:100] @ x.T
    s[np.arange(100), np.arange(100)] = -np.inf
    near = np.argsort(-s, 1)[:, :20]
    codes = h.code(np.floor(h.place(h.lift(x, False), 0)).astype("i8"))
    seen = h.visits(h.lift(x[:100], True), 0, h.probes)
    assert h.slot > 2 and np.mean([codes[v] in set(seen[i]) for i in range(100) for v in near[i]]) >= 0.9999


def brute_marginals(emit, step):
    import itertools

    t, k = emit.shape
    total = np.zeros((t, k))
    for path in itertools.product(range(k), repeat=t):
        w = math.exp(sum(emit[i, p] for i, p in enumerate(path)) + sum(step[a, b] for a, b in zip(path, path[1:])))
        for i, p in enumerate(path):
            total[i, p] += w
    return total / total.sum(1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(2)
    emit, step = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    m = language.forward_backward(emit, step, np.array([5, 3, 1]))[0]
    for i, n in enumerate((5, 3, 1)):
        assert np.allclose(m[i, :n], brute_marginals(emit[i, :n], step)) and not m[i, n:].any()


def test_stretches_are_one_chain():
    """A long text's shares are those of one chain, however it is cut."""
    rng, rnd = np.random.default_rng(4), random.Random(4)
    model = language.Chain(["a", "b", "c"], rng.normal(0, 0.4, ((1 << language.GRAM_BITS) + (1 << language.WORD_BITS), 3)).astype("f4"), np.array([[3.0, 0, -1], [-1, 2.5, 0], [0, -2, 3]], "f4"))
    pool = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choice(pool) for _ in range(n)) for n in (3, 511, 512, 513, 1024, 1500, 4000)] + ["", None]
    before = language.CHAIN
    found = {}
    for chain in (before, 64, 10_000):
        language.CHAIN = chain
        try:
            found[chain] = model.predict(texts)
        finally:
            language.CHAIN = before
    numbers = model._numbers(texts[:7])
    for x, got in zip(numbers, found[before]):
        m = language.forward_backward(model.table[x][None].astype("f8"), model.step, np.array([len(x)]))[0][0].sum(0)
        assert got[0] == model.labels[int(m.argmax())] and abs(got[1] - m.max() / m.sum()) < 1e-4
    for chain in found:
        assert [x for x, _ in found[chain]] == [x for x, _ in found[before]]
        assert np.allclose([y for _, y in found[chain]], [y for _, y in found[before]], atol=1e-4)


def test_language_many_and_odd(spark):
    """More than 32 languages, each learned; empty and long texts, ties, repeats, clashes."""
    names = [f"l{i:02d}" for i in range(36)]
    word = lambda i, j: f"{chr(97 + i // 6) * 3}{chr(103 + i % 6) * 3}{chr(110 + j)}"
    rows = [(100 * i + j, " ".join(word(i, (j + x) % 8) for x in range(12)), n) for i, n in enumerate(names) for j in range(12)]
    rows += [(9000, "", "l00"), (9001, rows[0][1], "l00"), (9001, rows[0][1], "l00"), (9002, " ".join([rows[0][1]] * 2000), "l00"), (None, rows[0][1], None)]
    d = spark.createDataFrame([(k, t, n, "x", 1) for k, t, n in rows], "doc_id long, text string, lang string, _lang string, _h int")
    model = language.train(d, F.lit(True), sequences=1500)
    # so many rows in all that each language gives two: all are learned still
    assert language.train(d, F.lit(True), sequences=50, most_rows=72).labels == names
    assert model.labels == names
    got = [(r.doc_id, r.lang, r.p.lang_pred) for r in d.select("doc_id", "lang", language.predict(model, F.col("text")).alias("p")).collect()]
    assert len(got) == len(rows) and sum(l == p for k, l, p in got if k != 9000) > 0.97 * len(rows)
    assert [p for k, _, p in got if k in (9001, 9002)] == ["l00"] * 3 and [p for k, _, p in got if k == 9000] == ["und"]


def test_language_reads_whole_texts(spark):
    """What tells languages apart lies at the end of long texts without letters before it."""
    rows = [(i, "12 34 " * 15000 + ("der die das und nicht" if i % 2 else "the and not with self"), "de" if i % 2 else "en") for i in range(6)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), sequences=300)
    assert [p for p, _ in model.predict(["und nicht die", "not with the"])] == ["de", "en"]
    parts = language.stretches_of(" ".join(f"w{i}" for i in range(5000)), -7, 200, 32)
    at = [int(p.split()[0][1:]) for p in parts]
    assert len(parts) == 200 and all(len(p.split()) == 32 for p in parts) and min(at) < 500 and max(at) > 4400


def test_language(spark):
    de, en = "der die das und nicht mit sich auch werden".split(), "the and not with self also become which".split()
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(de if i % 2 else en) + "" for _ in range(30)), "de" if i % 2 else "en") for i in range(80)]
    rows += [(90, None, "en"), (91, "12 34 !", None), (92, "der die das", None), (None, "und nicht", "de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d, F.lit(True), per_lang=64)
    got = {r.doc_id: r for r in d.select("doc_id", language.predict(model, F.col("text")).alias("p")).select("doc_id", "p.*").collect()}
    assert all(got[i].lang_pred == ("de" if i % 2 else "en") for i in range(80))
    assert (got[90].lang_pred, got[91].lang_pred, got[92].lang_pred) == ("und", "und", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = model.predict([" ".join(de * 5 + en * 2)])[0]
    assert mixed[0] == "de" and mixed[1] < 0.95
    assert language.train(d.limit(0), F.lit(True)).predict(["a"]) == [("und", 0.0)]


def test_queries_on_a_small_folder(spark, tmp_path):
    """Folds, columns and SQL of the registered queries themselves."""
    import duckdb

    from braidline.llm import queries

    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 9)) for _ in range(n))
    rows = [(i, text(30), "en" if i % 2 else "de") for i in range(60)] + [(60, None, "en"), (61, "", None), (62, text(2), "de")]
    rows += [(70, rows[3][1].replace(" ", " \t"), "en"), (71, rows[4][1] + " tail", "de")]
    spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, "u", text(400 if i % 2 else 3)) for i in range(20)] + [(20, "u", "z" * 2000), (21, None, "z" * 2000), (22, "u", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, text(12)) for i in range(5)] + [(5, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    base = np.random.default_rng(1).normal(size=(60, 8))
    spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(base)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {name: [r.asDict() for r in q(spark, str(tmp_path)).collect()] for name, q in queries.QUERIES.items()}
    crc = lambda k: zlib.crc32(str(k).encode())
    for name, fold in (("op2_lattice_lm", lambda k: crc(k) % 10 == 0), ("op4_toxicity", lambda k: crc(k) % 5 == 0), ("op10_language_id", lambda k: crc(k) % 4 == 2)):
        assert {r["doc_id"]: r["held_out"] for r in got[name]} == {k: fold(k) for k, _, _ in rows}
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got["op4_toxicity"])
    for name in ("op1_exact_dedup", "op3_byte_bpe", "op6_jaccard_join", "op8_token_files"):
        assert sorted(r["doc_id"] for r in got[name]) == sorted(k for k, _, _ in rows)
    links = brute_links([(k, t) for k, t, _ in rows])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got["op6_jaccard_join"]} == links and links[70][1] == 3
    assert len(got["op9_multiprobe_ann"]) == 3 * 20 and {r["doc_id"] for r in got["op7_best_fit_packing"]} == {k for k, _, _ in rows}
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        want = db.execute(sql).fetchall()
        columns = [d[0] for d in db.description]
        assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in got[name])
