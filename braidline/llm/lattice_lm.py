"""Language-model scoring by subword lattices.

A word's lattice has an arc for every piece of an existing vocabulary that spells part
of it (bytes at each letter, so that every word has a path). The vocabulary's scores are
ranks; a piece weighs 1 / (rank + SHIFT), normalised apart for pieces that begin a word
and those that go on, and after each piece the word stops with probability STOP. These
weights are a prior of PRIOR pieces for ``rounds`` of expectation maximisation over all
training words, each as often as it occurs. A forward recursion in log space then sums
all segmentations: the marginal P(word), a distribution over all words. A document is its
words and the end, each token being the end with the rate that training documents have;
its score is the marginal over all segmentations of the whole text.

Documents are taken in blocks. A block sends each distinct word once with its counts;
words of all blocks meet by word, where totals are summed and the lattice is run once a
word, and go back to their blocks, where documents are scored. What meets under one
word is one row a block, however common the word. Recursions run over all words of one
length at once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .tokens import chunks

STOP, SHIFT, PRIOR = 0.3, 10.0, 1000.0
END = b" "  # no word holds a space
MARK = "▁"
BLOCK_WORDS, BLOCK_CHARS = 300_000, 16_000_000
TABLE_BITS, TABLE_FACTORS = 19, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BASE = 0x100000001B3
CELLS = 1_500_000
_lattices: dict[str, "Lattice"] = {}


def _letters(words: list[str]):
    """Code points of words of one length behind the mark, a row a word."""
    import numpy as np

    text = "".join(MARK + w for w in words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, "<u4").reshape(len(words), -1)


def _add(logs):
    """Log of the summed exponentials over the first axis; -inf where all are."""
    import numpy as np

    top = logs.max(0)
    base = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(logs - base).sum(0)) + base


class Lattice:
    """Marginal log probabilities of words under a sentencepiece vocabulary. Piece numbers
    index ``begin`` and ``follow``, the log weights where a word begins and goes on."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        begin, follow, raw = {MARK: 1 / SHIFT}, {}, np.full(256, 1 / (n + SHIFT))
        for i in range(n):
            piece, rank = model.id_to_piece(i), -model.get_score(i)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and piece:
                (begin if piece.startswith(MARK) else follow)[piece] = 1 / (min(rank, n) + SHIFT)
        self.pieces = [*begin, *follow]
        total = sum(follow.values()) + raw.sum()
        with np.errstate(divide="ignore"):
            self.begin = np.log(np.array([*begin.values()] + [0.0] * len(follow)) / sum(begin.values()))
            self.follow = np.log(np.array([0.0] * len(begin) + [*follow.values()]) / total)
        self.bytes = np.log(raw / total)
        self.stop, self.go = math.log(STOP), math.log(1 - STOP)
        self.longest = max(map(len, self.pieces))
        self._index()

    def _index(self) -> None:
        """Tables from hashes of pieces to their numbers: what finds its place in one taken
        goes to the next."""
        import numpy as np

        self.hashes = np.zeros(len(self.pieces) + 1, "u8")
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * BASE + ord(c) + 1) % 2**64
            self.hashes[i] = h
        self.tables, left = [], np.arange(len(self.pieces))
        for factor in TABLE_FACTORS:
            if not len(left):
                break
            table = np.full(1 << TABLE_BITS, -1, "i4")
            at = (self.hashes[left] * np.uint64(factor)) >> np.uint64(64 - TABLE_BITS)
            table[at] = left
            left = left[table[at] != left]
            self.tables.append((np.uint64(factor), table))
        if len(left):
            raise ValueError("no place for a piece; choose larger tables")

    def _numbers(self, hashes):
        """Piece numbers, -1 where there is none."""
        import numpy as np

        out = np.full(hashes.shape, -1, "i4")
        for factor, table in self.tables:
            found = table[(hashes * factor) >> np.uint64(64 - TABLE_BITS)]
            out = np.where((self.hashes[found] == hashes) & (found >= 0), found, out)
        return out

    def _raw(self, letters):
        """Log weight of each letter as bytes, and the letters' distinct values."""
        import numpy as np

        every, inverse = np.unique(letters, return_inverse=True)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in every.tolist()]
        weight = np.array([self.bytes[list(b)].sum() + self.go * (len(b) - 1) for b in raw])
        return weight[inverse.reshape(letters.shape)], raw, inverse.reshape(letters.shape)

    def _arcs(self, words: list[str]):
        """For words of one length: numbers and log weights of the arcs by length and place
        (and word), and the weights of the bytes by place."""
        import numpy as np

        letters = _letters(words)
        n, m = letters.shape
        letters = np.ascontiguousarray(letters.T)
        ahead = np.zeros((m + 1, n), "u8")
        for i in range(m):
            ahead[i + 1] = ahead[i] * np.uint64(BASE) + letters[i] + np.uint64(1)
        numbers, weights = [], []
        for size in range(1, min(m, self.longest) + 1):
            found = self._numbers(ahead[size:] - ahead[:-size] * np.uint64(pow(BASE, size, 2**64)))
            weight = np.where(found >= 0, self.follow[found] + self.go, -np.inf)
            weight[0] = np.where(found[0] >= 0, self.begin[found[0]], -np.inf)
            numbers.append(found)
            weights.append(weight)
        raw, values, inverse = self._raw(letters)
        raw += self.go
        raw[0] = -np.inf
        return m, numbers, weights, raw, values, inverse

    def _forward(self, m, weights, raw):
        import numpy as np

        n = raw.shape[1]
        ahead = np.full((m + 1, n), -np.inf)
        ahead[0] = 0.0
        for j in range(1, m + 1):
            ways = [ahead[j - s] + weights[s - 1][j - s] for s in range(1, min(j, len(weights)) + 1)]
            ahead[j] = _add(np.stack([*ways, ahead[j - 1] + raw[j - 1]]))
        return ahead

    def _by_length(self, words: list[str]):
        """Places of words of one length, a bounded number of lattice cells at a time."""
        import numpy as np

        sizes = np.fromiter(map(len, words), "i8", len(words))
        order = np.argsort(sizes, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else ():
            m = int(sizes[some[0]]) + 1
            step = max(1, CELLS // (m * min(m, self.longest)))
            for i in range(0, len(some), step):
                yield some[i : i + step]

    def log_probabilities(self, words: list[str]):
        """Log marginal of each word: a forward recursion over all its segmentations."""
        import numpy as np

        out = np.zeros(len(words))
        for some in self._by_length(words):
            m, _, weights, raw, _, _ = self._arcs([words[i] for i in some])
            out[some] = self._forward(m, weights, raw)[m] + self.stop
        return out

    def expected(self, words: list[str], times):
        """Expected uses of each piece as a beginning and further on, and of each byte, in
        words that occur so many times."""
        import numpy as np

        begins, follows, raws = np.zeros(len(self.pieces)), np.zeros(len(self.pieces)), np.zeros(256)
        times = np.asarray(times, "f8")
        for some in self._by_length(words):
            m, numbers, weights, raw, values, inverse = self._arcs([words[i] for i in some])
            ahead = self._forward(m, weights, raw)
            behind = np.full_like(ahead, -np.inf)
            behind[m] = 0.0
            for i in range(m - 1, -1, -1):
                ways = [behind[i + s] + weights[s - 1][i] for s in range(1, min(m - i, len(weights)) + 1)]
                behind[i] = _add(np.stack([*ways, behind[i + 1] + raw[i]]))
            total, share = ahead[m], times[some]
            for s, (found, weight) in enumerate(zip(numbers, weights), 1):
                mass = np.exp(ahead[: m + 1 - s] + weight + behind[s:] - total) * share
                begins += np.bincount(np.maximum(found[0], 0), mass[0], len(self.pieces))
                follows += np.bincount(np.maximum(found[1:], 0).ravel(), mass[1:].ravel(), len(self.pieces))
            mass = np.bincount(inverse.ravel(), (np.exp(ahead[:-1] + raw + behind[1:] - total) * share).ravel(), len(values))
            for x, b in zip(mass.tolist(), values):
                np.add.at(raws, list(b), x)
        return begins, follows, raws

    def adapted(self, begins, follows, raws, n_words: float) -> "Lattice":
        """A lattice with weights by expected uses on top of this one's as the prior."""
        import copy

        import numpy as np

        out = copy.copy(self)
        n_begin, n_follow = begins.sum(), follows.sum() + raws.sum()
        with np.errstate(divide="ignore"):
            out.begin = np.log((begins + PRIOR * np.exp(self.begin)) / (n_begin + PRIOR))
            out.follow = np.log((follows + PRIOR * np.exp(self.follow)) / (n_follow + PRIOR))
            out.bytes = np.log((raws + PRIOR * np.exp(self.bytes)) / (n_follow + PRIOR))
        stop = (n_words + PRIOR * STOP) / (n_begin + n_follow + PRIOR)
        out.stop, out.go = math.log(stop), math.log(1 - stop)
        return out


def lattice(path: str) -> Lattice:
    """The vocabulary's lattice before training, kept by this process."""
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def _text(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace") for w in words]


def _blocks(batches):
    """Rows of documents (word numbers and counts) and of words (training counts)."""
    import uuid

    import numpy as np

    def fresh():
        return defaultdict(count(1).__next__, {END: 0}), [], [], 0, uuid.uuid4().hex

    def rows():
        keys = np.concatenate(held) if held else np.zeros(0, "i8")
        n = len(number)
        counts = np.bincount(keys, minlength=n)
        nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())]
        yield pa.record_batch([pa.array([block] * n), *nulls, pa.array(np.arange(n)), pa.array(list(number), pa.binary()), pa.array(counts.astype("i8"))], names)
        cols = list(zip(*docs))
        n = len(docs)
        doc_rows = [pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary())]
        yield pa.record_batch([pa.array([block] * n), *doc_rows, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())], names)

    names = ["block", "doc_id", "held_out", "n_tokens", "at", "times", "number", "word", "n"]
    number, docs, held, size, block = fresh()
    for b in batches:
        texts = b.column(2).to_pylist()
        for lo, hi in chunks(texts):
            for key, out, text in zip(*(b.column(c).slice(lo, hi - lo).to_pylist() for c in range(2)), texts[lo:hi]):
                words = (text or "").encode("utf-8", "replace").lower().split()
                at = np.fromiter(map(number.__getitem__, words), "i8", len(words))
                at = np.append(at, 0)
                if not out:
                    held.append(at)
                ids, times = np.unique(at, return_counts=True)
                docs.append((key, out, len(at), ids.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
                size += len(text or "")
                if len(number) >= BLOCK_WORDS or size >= BLOCK_CHARS:
                    yield from rows()
                    number, docs, held, size, block = fresh()
            # counts so far, so that memory follows distinct words and not the text
            if len(held) > 1:
                held = [np.concatenate(held)]
    if docs:
        yield from rows()


def _fit(met: DataFrame, path: str, rounds: int) -> Lattice:
    """The lattice adapted to the training words (word, n, first) of ``met``."""
    prior = model = lattice(path)
    n_pieces = len(prior.pieces)
    learned = met.where(F.col("first") & (F.col("n") > 0) & (F.col("word") != F.lit(END))).select("word", "n")
    n_words = learned.agg(F.sum("n")).first()[0] or 0
    for _ in range(rounds if n_words else 0):

        def expect(batches, model=model):
            import numpy as np

            total = np.zeros(2 * n_pieces + 256)
            for b in batches:
                total += np.concatenate(model.expected(_text(b.column(0).to_pylist()), np.asarray(b.column(1))))
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total[at])], ["at", "uses"])

        # at most two rows a piece of the vocabulary reach the driver
        found = learned.mapInArrow(expect, "at long, uses double").groupBy("at").agg(F.sum("uses").alias("uses")).collect()
        import numpy as np

        uses = np.zeros(2 * n_pieces + 256)
        uses[[r["at"] for r in found]] = [r.uses for r in found]
        model = prior.adapted(uses[:n_pieces], uses[n_pieces : 2 * n_pieces], uses[2 * n_pieces :], float(n_words))
    return model


def score_documents(docs: DataFrame, held_out: Column, path: str, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, counted_score.

    ``score`` is the text's log10 marginal over all segmentations; ``counted_score`` is that
    of a model with the training counts of words on top, P(w) = (c + a P(w)) / (N + a) with
    a the number of words met once. ``held_out`` tells which rows train nothing. Null texts
    count as empty: the end alone. Repeated rows, and rows that share an id, count each.
    Words of any length are spelled out whole. Without training rows the vocabulary's own
    weights score. An empty table gives no rows."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    schema = "block string, doc_id long, held_out boolean, n_tokens long, at binary, times binary, number long, word binary, n long"
    rows = materialise(picked.mapInArrow(_blocks, schema), "lattice-blocks")
    words = rows.where(F.col("word").isNotNull()).select("block", "number", "word", "n")
    by_word = Window.partitionBy("word")
    first = F.row_number().over(by_word.orderBy("block")) == 1
    met = materialise(words.select("word", "block", "number", F.sum("n").over(by_word).alias("n"), first.alias("first")), "lattice-words")
    n = F.col("n")
    ask = [F.sum("n"), F.sum((n > 0).cast("long")), F.sum((n == 1).cast("long")), F.sum(F.when(F.col("word") == F.lit(END), n))]
    total, v, once, ends = (x or 0 for x in met.where("first").agg(*ask).first())
    a = max(1, once)
    floor = total + 0.1 * (v + 1)
    end_rate = (ends + 1) / (total + 2)
    log_end, log_word = math.log(end_rate), math.log(1 - end_rate)
    model = _fit(met, path, rounds)

    def spell(batches):
        import numpy as np

        for b in batches:
            # rows of one word stand together
            raw = b.column(0).to_pylist()
            new = [i for i, w in enumerate(raw) if not i or w != raw[i - 1]]
            value = model.log_probabilities(_text([raw[i] for i in new])) + log_word
            value[[raw[i] == END for i in new]] = log_end
            spelled = np.repeat(value, np.diff([*new, len(raw)]))
            yield pa.record_batch([*b.columns[1:], pa.array(spelled)], ["block", "number", "n", "spelled"])

    spelled = met.drop("first").mapInArrow(spell, "block string, number long, n long, spelled double")

    def score(key, docs, words):
        import numpy as np

        if not docs.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(out_names, out_types)})
        order = np.argsort(np.asarray(words.column("number")))
        c, spelled = (np.asarray(words.column(x))[order].astype("f8") for x in ("n", "spelled"))
        with np.errstate(divide="ignore"):
            counted = np.logaddexp(np.log(c), math.log(a) + spelled) - math.log(total + a)
        columns = [np.log10((c + 0.1) / floor), spelled / math.log(10), counted / math.log(10)]
        known, out = c > 0, []
        for at, times in zip(docs.column("at").to_pylist(), docs.column("times").to_pylist()):
            at, times = np.frombuffer(at, "<u4"), np.frombuffer(times, "<u4").astype("f8")
            out.append((int(times @ known[at]), total, *(float(times @ x[at]) for x in columns)))
        given = [docs.column(x).combine_chunks() for x in ("doc_id", "held_out", "n_tokens")]
        return pa.table(given + [pa.array(x, t) for x, t in zip(zip(*out), out_types[3:])], out_names)

    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "counted_score"]
    out_types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3]
    documents = rows.where(F.col("word").isNull()).select("block", "doc_id", "held_out", "n_tokens", "at", "times")
    out_schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, counted_score double"
    return documents.groupBy("block").cogroup(spelled.groupBy("block")).applyInArrow(score, out_schema)
