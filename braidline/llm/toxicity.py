"""Toxicity by a factorization machine over hashed terms.

A text's features are its distinct terms (runs of letters, lower case) and their stems
(first four, five and six letters), by 32-bit hash. The score is logistic in bias + sum of term weights + sum over pairs of terms of
the inner product of their factors; the pair part is computed in time linear in the
terms. Pairs learn what single weights miss, such as an insult next to a group name.

The fit uses a bounded sample of labelled rows (``max_rows``, by hash of the id, spread
over the whole table). A feature takes part if it tells the labels apart beyond chance,
alone or in a pair: alone, if its log-likelihood ratio with the label exceeds twice the
log of the number of features; in a pair of terms, if each of the two tells the labels
apart among the texts that have the other, by twice the log of the number of pairs. So
terms that are neutral alone take part if they tell together. Scoring covers every row
and the whole text.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

STEMS = (4, 5, 6)
TERM = re.compile(r"[^\W\d_]+")
KEEP_TERMS = 400_000


def terms(text: str | None) -> set[str]:
    return set(TERM.findall((text or "").lower()))


def hashes(term: str) -> list[int]:
    """The term's hash, which is odd, and those of its stems, which are even."""
    stems = {f"{term[:n]}-" for n in STEMS if len(term) >= n}
    return [zlib.crc32(term.encode("utf-8", "replace")) | 1, *(zlib.crc32(x.encode("utf-8", "replace")) & ~1 for x in sorted(stems))]


class Machine:
    """Fitted weights; rows of ``weights`` and ``factors`` belong to ``hashes``."""

    def __init__(self, hashes, weights, factors, bias: float):
        self.hashes, self.weights, self.factors, self.bias = hashes, weights, factors, bias
        self.rows: dict[str, tuple[int, ...]] | None = None
        self.place: dict[int, int] | None = None

    def __getstate__(self):
        return {**self.__dict__, "rows": None, "place": None}

    def _rows(self, term: str) -> tuple[int, ...]:
        if len(self.rows) >= KEEP_TERMS:
            self.rows.clear()
        found = self.rows[term] = tuple(r for h in hashes(term) if (r := self.place.get(h)) is not None)
        return found

    def score(self, texts) -> list[float]:
        import numpy as np

        if self.rows is None:
            self.rows, self.place = {}, {h: i for i, h in enumerate(self.hashes.tolist())}
        out, get = [], self.rows.get
        for x in texts:
            at = set()
            for t in terms(x):
                rows = get(t)
                at.update(self._rows(t) if rows is None else rows)
            margin = self.bias
            if at:
                at = np.fromiter(at, "i8", len(at))
                at.sort()
                v = self.factors[at].astype("f8")
                margin += float(self.weights[at].sum(dtype="f8") + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))
            out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, margin)))))
        return out


def deviance(k, n, rest_k, rest_n):
    """Twice the log-likelihood ratio of two groups (k of n, rest_k of rest_n) having
    rates of their own against one rate for both; arrays."""
    import numpy as np

    p = (k + rest_k) / np.maximum(n + rest_n, 1)

    def part(k, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = np.where(k > 0, k * np.log(k / (n * p)), 0.0)
            miss = np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - p))), 0.0)
        return hit + miss

    return 2 * (part(k, n) + part(rest_k, rest_n))


def _counts(rows, y):
    """The different hashes of all rows, in order, with how many rows and how many toxic
    rows have each; no list is as long as all rows together but that which is sorted."""
    import numpy as np

    every, n = np.unique(np.concatenate(rows), return_counts=True)
    k = np.zeros(len(every), "i8")
    hit = [h for h, v in zip(rows, y) if v > 0]
    if hit:
        some, times = np.unique(np.concatenate(hit), return_counts=True)
        k[np.searchsorted(every, some)] = times
    return every, n, k


def informative(rows, y, min_docs: int):
    """Hashes of the features that tell the labels apart beyond chance, in order."""
    import numpy as np

    every, n, k = _counts([h for h, _ in rows], y)
    n, k = n.astype("f8"), k.astype("f8")
    ratio = deviance(k, n, y.sum() - k, len(y) - n)
    ratio[n < min_docs] = 0
    return every[ratio >= 2 * np.log(max(2, len(every)))]


def _pairs(p: int, q: int, m: int):
    """Places of the pairs of m terms whose first member is one of p to q."""
    import numpy as np

    n = m - 1 - np.arange(p, q)
    first = np.repeat(np.arange(p, q), n)
    return first, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first + 1


def telling_pairs(rows, y, min_docs: int, cells_at_once: int = 4_000_000):
    """Hashes of the terms of pairs of which each member tells the labels apart among the
    texts that have the other. All pairs of terms with ``min_docs`` texts are tested: a
    term whose labels hold too little entropy for any split of its texts to tell is in no
    such pair, and the pairs of the rest are counted exactly, in rounds, whatever number of
    terms a row has."""
    import numpy as np

    term_rows = [h[h & 1 == 1] for h, _ in rows]
    every, n, k = _counts(term_rows, y)
    k = k.astype("f8")
    common = int((n >= min_docs).sum())
    if common < 2:
        return every[:0]
    least = 2 * np.log(common * (common - 1) / 2)
    # the deviance of a split into its toxic and its other texts, which no split exceeds
    terms = every[(n >= min_docs) & (deviance(k, k, 0 * k, n - k) >= least)]
    if len(terms) < 2:
        return terms[:0]
    at = []
    for h in term_rows:
        i = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        at.append(i[terms[i] == h])
    flat, label = np.concatenate(at), np.repeat(y, [len(i) for i in at])
    n = np.bincount(flat, minlength=len(terms)).astype("f8")
    k = np.bincount(flat, label, minlength=len(terms))
    # a row's pairs in order of their first member, so that a range of first members, a
    # round, is a stretch of them; a round's pairs and counters are bounded
    ahead = np.bincount(flat, np.concatenate([np.arange(len(i))[::-1] for i in at]), minlength=len(terms)).astype("i8")
    cost = ahead + len(terms)
    round_of = (np.cumsum(cost) - cost) // cells_at_once
    shapes: dict = {}
    found = []
    for turn in np.unique(round_of):
        low, high = np.searchsorted(round_of, [turn, turn + 1])
        keys: tuple = ([], [])
        for i, v in zip(at, y):
            m = len(i)
            p, q = np.searchsorted(i, [low, high])
            if p == q or p + 1 >= m:
                continue
            if m > 256:
                a, b = (i[x] for x in _pairs(p, q, m))
            else:  # many rows are as long as others
                if m not in shapes:
                    shapes[m] = [x.astype("u2") for x in np.triu_indices(m, 1)]
                mine = slice(p * (2 * m - p - 1) // 2, q * (2 * m - q - 1) // 2)
                a, b = (i[x[mine]] for x in shapes[m])
            keys[int(v > 0)].append(((a - low) * len(terms) + b).astype("i4"))
        if not keys[0] and not keys[1]:
            continue
        size = (high - low) * len(terms)
        clean, hit = (np.bincount(np.concatenate(x), minlength=size) if x else np.zeros(size, "i8") for x in keys)
        pair = np.flatnonzero(clean + hit >= min_docs)
        both, hit = (clean[pair] + hit[pair]).astype("f8"), hit[pair].astype("f8")
        a, b = pair // len(terms) + low, pair % len(terms)
        tells = np.minimum(deviance(hit, both, k[a] - hit, n[a] - both), deviance(hit, both, k[b] - hit, n[b] - both)) >= least
        found += [a[tells], b[tells]]
    return terms[np.unique(np.concatenate(found))] if found else terms[:0]


def fit(rows, *, rank: int = 4, min_docs: int = 3, pair_docs: int = 10, epochs: int = 30, rate: float = 0.1, decay: float = 1e-4, seed: int = 7):
    """A Machine from (hashes, label) rows; adaptive gradient steps on log loss."""
    import numpy as np

    rows = [(np.frombuffer(h, "<u4"), int(y)) for h, y in rows]
    if not rows:
        return Machine(np.zeros(0, "u4"), np.zeros(0, "f4"), np.zeros((0, rank), "f4"), -30.0)
    y = np.array([v for _, v in rows], "f4")
    hashes = np.union1d(informative(rows, y, min_docs), telling_pairs(rows, y, pair_docs)).astype("u4")
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    rng = np.random.default_rng(seed)
    bias, w = float(np.log(p / (1 - p))), np.zeros(len(hashes), "f4")
    v = rng.normal(0, 0.02, (len(hashes), rank)).astype("f4")
    if not len(hashes) or y.min() == y.max():
        return Machine(hashes, w, v * 0, bias)
    at = []
    for h, _ in rows:
        i = np.searchsorted(hashes, h)
        i[i == len(hashes)] = 0
        at.append(i[hashes[i] == h])
    gw, gv, gb = np.full(len(hashes), 1e-3, "f4"), np.full((len(hashes), rank), 1e-3, "f4"), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 256)):
            sizes = np.array([len(at[i]) for i in batch])
            flat = np.concatenate([at[i] for i in batch])
            doc = np.repeat(np.arange(len(batch)), sizes)
            starts = np.cumsum(sizes) - sizes
            full = sizes > 0
            vf = v[flat]
            sums = np.zeros((len(batch), rank), "f4")
            lin, squares = np.zeros(len(batch), "f4"), np.zeros(len(batch), "f4")
            if len(flat):
                sums[full] = np.add.reduceat(vf, starts[full])
                lin[full] = np.add.reduceat(w[flat], starts[full])
                squares[full] = np.add.reduceat((vf**2).sum(1), starts[full])
            margin = bias + lin + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch]).astype("f4")
            g = err.sum() / len(batch)
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            order_f = np.argsort(flat, kind="stable")
            ids, first = np.unique(flat[order_f], return_index=True)
            if not len(ids):
                continue
            e = err[doc][order_f, None]
            dw = np.add.reduceat(e[:, 0], first) / len(batch) + decay * w[ids]
            dv = np.add.reduceat(e * (sums[doc][order_f] - vf[order_f]), first) / len(batch) + decay * v[ids]
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= rate * dv / np.sqrt(gv[ids])
    return Machine(hashes, w, v, bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, *, max_rows: int = 8_000, id_col="doc_id", text_col="text", label_col="toxic", **options) -> Machine:
    """Fit on at most ``max_rows`` labelled rows for which ``usable`` (on ``id_col``)
    holds. Null labels or ids are left out; an id labelled twice counts as toxic if any
    label says so; of rows that share an id, the one whose text's hash is smallest trains."""
    chosen = (
        labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label"))
        .where(F.col("_label").isNotNull() & F.col(id_col).isNotNull() & usable)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(max_rows)
    )
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "_id long, _label int")

    @F.pandas_udf(T.BinaryType())
    def hashed(text):
        import numpy as np

        return text.map(lambda x: np.unique(np.array([h for t in terms(x) for h in hashes(t)], "<u4")).tobytes())

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # of rows that share an id one, so that no more rows reach the driver than were chosen
    one = Window.partitionBy("_id").orderBy(F.xxhash64("_text"))
    rows = picked.withColumn("_r", F.row_number().over(one)).where("_r = 1").select("_id", hashed("_text").alias("h"), "_label").collect()
    return fit([(r.h, r._label) for r in sorted(rows, key=lambda r: r._id)], **options)


def score(model: Machine, text: Column) -> Column:
    """The score of a text, 0 to 1; null counts as empty, which scores as the bias. Rows
    with equal texts score alike, and an empty table gives no rows."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(texts), dtype="float64")

    return scored(text)
