"""Language identification by a linear-chain conditional random field over words.

Words are white-space tokens with a letter, lower case. A word's features are its byte
n-grams of one to four bytes with marks at both ends (so its affixes are among them)
and the word itself (the lexicon); each feature has a weight a language, hashed into a
table. Transitions between the labels of neighbouring words are learned too, from
training sequences that join stretches of documents in different languages. Prediction
runs forward-backward over every word of the whole text and adds the words' marginals up;
the language of the largest sum is predicted, with its share as the score.

A long text is worked on in stretches of ``CHAIN`` words, all at once: each stretch first
gives the matrix by which it carries messages from end to end, the matrices' products
give the messages at all borders, and with these each stretch's marginals are those of
the whole chain.

The fit uses a bounded sample of rows (``per_lang`` a language and about ``most_rows`` in
all, by hash of the row). The training sequences join stretches of their texts; a row's
stretches are drawn over its whole text where the text lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

GRAM_BITS, WORD_BITS, ORDERS = 17, 18, 4
CHAIN = 512
KEEP_WORDS = 150_000
UNKNOWN = "und"
SLOTS = 64


def word_features(words: list[bytes]):
    """Feature numbers of all words in a row, and where each word's begin."""
    import numpy as np

    marked = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), "u1").astype("u8")
    sizes = np.fromiter((len(w) + 2 for w in words), "i8", len(words))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(len(marked))  # bytes from here to the word's end
    keys, owner = [], []
    state = np.zeros(len(marked), "u8")
    for n in range(1, ORDERS + 1):
        shifted = np.zeros(len(marked), "u8")
        shifted[: len(marked) - n + 1] = marked[n - 1 :]
        state = state * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        ok = left >= n
        mixed = (state[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        keys.append((mixed >> np.uint64(64 - GRAM_BITS)).astype("i8"))
        owner.append(word[ok])
    # the lexicon feature: a hash of all the word's bytes
    power = np.uint64(0x100000001B3) ** (left.astype("u8"))
    whole = np.add.reduceat((marked + np.uint64(1)) * power, ends - sizes) * np.uint64(0x9E3779B97F4A7C15)
    keys.append((whole >> np.uint64(64 - WORD_BITS)).astype("i8") + (1 << GRAM_BITS))
    owner.append(np.arange(len(words)))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return keys[order], np.searchsorted(owner[order], np.arange(len(words)))


def forward_backward(emit, step, lengths, enter=None, after=None):
    """Marginals of chains: ``emit`` (chains, words, labels) are log scores, ``step``
    the labels' transition log scores; also what expected transitions need. A chain that
    is a stretch of a longer one has the message that comes in (``enter``, past the
    transition) and the one from behind its last word (``after``)."""
    import numpy as np

    n, t, k = emit.shape
    top = emit.max(2, keepdims=True)
    e = np.exp(emit - top)
    move = np.exp(step)
    alive = np.arange(t)[None, :] < lengths[:, None]
    ahead, scale = np.empty_like(e), np.ones((n, t), e.dtype)
    behind = np.ones((n, k), e.dtype) if after is None else after
    a = e[:, 0] / k if enter is None else e[:, 0] * enter
    for i in range(t):
        if i:
            a = (a @ move) * e[:, i]
        s = a.sum(1)
        a = a / s[:, None]
        ahead[:, i], scale[:, i] = a, s
    back = np.empty_like(e)
    b = behind.copy()
    for i in range(t - 1, -1, -1):
        if i < t - 1:
            b = ((e[:, i + 1] * b) @ move.T) / scale[:, i + 1, None]
            last = ~alive[:, i + 1]
            b[last] = behind[last]
        back[:, i] = b
    marginal = ahead * back
    if after is not None:
        marginal /= marginal.sum(2, keepdims=True)
    marginal *= alive[:, :, None]
    return marginal, ahead, back, e, scale, move, alive


def carried(emit, step, lengths, first):
    """The matrix by which each stretch carries a message from before it to its last word,
    up to a factor; a ``first`` stretch has no transition into it."""
    import numpy as np

    n, t, k = emit.shape
    e = np.exp(emit - emit.max(2, keepdims=True))
    move = np.exp(step)
    out = np.broadcast_to(np.eye(k, dtype=e.dtype), (n, k, k)).copy()
    for i in range(t):
        new = (out @ move if i else np.where(first[:, None, None], out, out @ move)) * e[:, i, None, :]
        new /= new.sum((1, 2), keepdims=True)
        out = np.where((i < lengths)[:, None, None], new, out)
    return out


class Chain:
    def __init__(self, labels: list[str], weights, step):
        self.labels, self.weights, self.step = labels, weights, step
        self.kept = None

    def __getstate__(self):
        return {**self.__dict__, "kept": None}

    def emissions(self, words: list[bytes]):
        import numpy as np

        keys, starts = word_features(words)
        return np.add.reduceat(self.weights[keys], starts, axis=0) if words else np.zeros((0, len(self.labels)), "f4")

    def _numbers(self, texts):
        """Rows of ``self.table`` for each text's words with a letter."""
        import numpy as np

        if self.kept is None or len(self.kept) > KEEP_WORDS:
            self.kept, self.table = {}, np.zeros((0, len(self.labels)), "f4")
        kept = self.kept
        cut = [(x or "").lower().split() for x in texts]
        new = [w for w in set().union(*cut) if w not in kept]
        worded = []
        for w in new:
            if any(map(str.isalpha, w)):
                kept[w] = len(self.table) + len(worded)
                worded.append(w.encode("utf-8", "replace"))
            else:
                kept[w] = -1
        if worded:
            self.table = np.concatenate([self.table, self.emissions(worded)])
        out = [np.fromiter(map(kept.__getitem__, x), "i4", len(x)) for x in cut]
        return [x[x >= 0] for x in out]

    def _batches(self, stretches, found, times: int):
        """Stretches of like lengths, longest first, with the numbers of their words."""
        import numpy as np

        left = sorted(stretches, reverse=True)
        at = 0
        while at < len(left):
            t = left[at][0]
            some = left[at : at + max(1, 400_000 // (t * times))]
            at += len(some)
            rows = np.zeros((len(some), t), "i4")
            for r, (n, d, i) in enumerate(some):
                rows[r, :n] = found[d][i : i + n]
            yield some, rows, np.array([s[0] for s in some])

    def predict(self, texts) -> list[tuple[str, float]]:
        import numpy as np

        if not self.labels:
            return [(UNKNOWN, 0.0)] * len(texts)
        found = self._numbers(texts)
        total = np.zeros((len(texts), len(self.labels)))
        k = len(self.labels)
        # length, text, first word, and for stretches of long texts the messages at both ends
        stretches = [(min(CHAIN, len(x) - i), d, i) for d, x in enumerate(found) for i in range(0, len(x), CHAIN)]
        long = [s for s in stretches if len(found[s[1]]) > CHAIN]
        matrices = {}
        for some, rows, lengths in self._batches(long, found, k):
            first = np.array([i == 0 for _, _, i in some])
            for (_, d, i), m in zip(some, carried(self.table[rows], self.step, lengths, first)):
                matrices[d, i] = m
        enter, after = {}, {}
        for d in {d for _, d, _ in long}:
            places = range(0, len(found[d]), CHAIN)
            a = np.ones(k)
            for i in places:
                enter[d, i] = a / a.sum() if i == 0 else a @ np.exp(self.step)
                a = a @ matrices[d, i]
                a /= a.sum()
            b = np.ones(k)
            for i in reversed(places):
                after[d, i] = b
                b = matrices[d, i] @ b
                b /= b.sum()
        ones = np.ones(k)
        for some, rows, lengths in self._batches(stretches, found, 1):
            ends = [np.stack([m.get(s[1:], ones) for s in some]) for m in (enter, after)]
            marginal = forward_backward(self.table[rows], self.step, lengths, *ends)[0]
            np.add.at(total, [s[1] for s in some], marginal.sum(1))
        best = total.argmax(1)
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-300)
        return [(self.labels[j], float(share[i, j])) if len(found[i]) else (UNKNOWN, 0.0) for i, j in enumerate(best.tolist())]


def fit(samples: list[tuple[str, list[str]]], *, sequences: int = 5000, span: int = 32, epochs: int = 3, rate: float = 0.3, decay: float = 1e-5, seed: int = 5) -> Chain:
    """A Chain from (language, stretches of a text) rows."""
    import numpy as np

    rng = np.random.default_rng(seed)
    labels = sorted({lang for lang, _ in samples})
    k = len(labels)
    weights, step = np.zeros(((1 << GRAM_BITS) + (1 << WORD_BITS), k), "f4"), np.zeros((k, k), "f4")
    words = {lang: [] for lang in labels}
    for lang, parts in samples:
        if parts:
            words[lang].append(parts)  # as text: most are never drawn, and their words would fill the driver
    usable = [i for i, lang in enumerate(labels) if words[lang]]
    if not usable:
        return Chain(labels, weights, step)
    x, y = [], []
    for _ in range(sequences):
        seq, lab = [], []
        while len(seq) < span:
            i = int(rng.choice(usable))
            doc = words[labels[i]][rng.integers(len(words[labels[i]]))]
            doc = [w.encode("utf-8", "replace") for w in doc[rng.integers(len(doc))].split()]
            n = int(rng.integers(4, span))
            at = int(rng.integers(0, max(1, len(doc) - n + 1)))
            seq += doc[at : at + n]
            lab += [i] * len(doc[at : at + n])
        x.append(seq[:span])
        y.append(lab[:span])
    y = np.array(y)
    lengths = np.full(128, span)
    sq, ss = np.full(weights.shape, 1e-2, "f4"), np.full((k, k), 1e-2, "f4")
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            n = len(batch)
            keys, starts = word_features([w for i in batch for w in x[i]])
            emit = np.add.reduceat(weights[keys], starts, axis=0).reshape(n, span, k)
            marginal, ahead, back, e, scale, move, _ = forward_backward(emit, step, np.full(n, span))
            gold = np.eye(k, dtype="f4")[y[batch]]
            error = (marginal - gold).reshape(-1, k).astype("f4")
            pair = np.einsum("nti,ij,ntj->ij", ahead[:, :-1], move, e[:, 1:] * back[:, 1:] / scale[:, 1:, None])
            seen = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
            g = (pair - seen) / n
            ss += g * g
            step -= rate * g / np.sqrt(ss)
            sizes = np.diff(np.append(starts, len(keys)))
            for j in range(k):
                g = np.bincount(keys, np.repeat(error[:, j], sizes), len(weights)).astype("f4") / n
                hit = np.flatnonzero(g)
                g = g[hit] + decay * weights[hit, j]
                sq[hit, j] += g * g
                weights[hit, j] -= rate * g / np.sqrt(sq[hit, j])
    return Chain(labels, weights, step)


def stretches_of(text: str, seed: int, most: int, words: int) -> list[str]:
    """Up to ``most`` stretches of ``words`` words with a letter, lower case, their places
    drawn over the whole text; a text of no more words is one stretch, one without any none."""
    import numpy as np

    found = [w for w in text.lower().split() if any(map(str.isalpha, w))]
    if len(found) <= words:
        return [" ".join(found)] if found else []
    at = np.random.default_rng(seed % (1 << 63)).integers(0, len(found) - words + 1, most)
    return [" ".join(found[i : i + words]) for i in at.tolist()]


def train(
    docs: DataFrame, usable: Column, *, per_lang: int = 800, most_rows: int = 80_000, stretches: int = 16, id_col="doc_id", text_col="text", lang_col="lang", **options
) -> Chain:
    """Fit on about ``per_lang`` rows of each language among rows with an id, a language
    and a text for which ``usable`` (on ``id_col``) holds: a bound for the driver, whatever
    the table's size. Where languages are so many that these would be over ``most_rows``,
    each gives an equal share, and one row at least, so that all are learned. Repeated rows
    count each, but one row's copies fill no more than one of ``SLOTS`` shares of its
    language. A row gives up to ``stretches`` stretches of its whole text."""
    key = ["_id", "_lang", "_h"]
    text, row = F.col(text_col), F.col(id_col).cast("long")
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0) & usable)
    rows = rows.select(row.alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(row, text).alias("_h"), text.alias("_text"))
    # a language's rows are dealt to SLOTS groups, each of which gives its share; texts stay behind
    order = Window.partitionBy("_lang", F.pmod("_h", F.lit(SLOTS))).orderBy("_h", "_id")
    picked = rows.select(*key).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= -(-per_lang // SLOTS))
    picked = materialise(picked, "language-rows")
    langs = picked.select("_lang").distinct().count()
    if langs * per_lang > most_rows:
        share = Window.partitionBy("_lang").orderBy("_r", "_h", "_id")
        picked = picked.withColumn("_s", F.row_number().over(share)).where(F.col("_s") <= max(1, most_rows // langs))
    times = picked.groupBy(*key).agg(F.count("*").alias("_n"))
    # the side sent whole has at most a row for each of the rows above
    texts = rows.join(F.broadcast(times), key).groupBy(*key, "_n").agg(F.first("_text").alias("_text"))
    span = options.get("span", 32)

    @F.pandas_udf("array<string>")
    def drawn(texts, seeds):
        import pandas as pd

        return pd.Series([stretches_of(t, int(h), stretches, span) for t, h in zip(texts, seeds)], dtype=object)

    chosen = texts.select(*key, "_n", drawn("_text", "_h").alias("_parts")).collect()
    return fit([(r._lang, list(r._parts)) for r in sorted(chosen, key=lambda r: (r._id, r._lang, r._h)) for _ in range(r._n)], **options)


def predict(model: Chain, text: Column) -> Column:
    """struct(lang_pred, score); ``und`` and 0 where there is no letter (null and empty texts
    too). Ties go to the language that sorts first; rows with equal texts fare alike."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts):
        import pandas as pd

        out = []
        for i in range(0, len(texts), 1000):
            out += model.predict(texts.iloc[i : i + 1000].tolist())
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return predicted(text)
