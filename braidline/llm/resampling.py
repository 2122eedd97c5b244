"""Importance resampling towards a target corpus, by hashed word features.

Features are runs of consecutive words, joined by a space; a feature's bucket is the crc32
of its bytes. Every task keeps a trie of the features of its rows: a node stands for a
prefix, with the crc32 register after that prefix (so a step of one byte continues it) and
the number of features that end there. A full trie is emptied into the task's bucket
totals, and so is the last one; tasks give one row a bucket, which Spark adds up.

Scoring walks the same kind of trie, where a node carries its bucket's gain: the log ratio
of the bucket's share in the target to that in the corpus, in thousandths. A document's
weight is its features' mean gain. Gumbel noise from a hash of its id makes the highest
scores a draw without replacement, in proportion to the weights' exponentials.

What the driver holds is bounded by the parameters: a total a bucket, and a count a score
(an integer between about -45,000 and 65,000, as gains and noise are logarithms).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

#: Words in lower-cased UTF-8: ASCII letters and digits, and all bytes of other letters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: The trie holds so many bytes of a feature; the rest of a longer one only runs through
#: the register.
DEPTH = 48
_ONE = [bytes([b]) for b in range(256)]


class WordTrie:
    """Features by their bytes. A node that only one feature has passed keeps that
    feature's rest. ``values`` are counts, or the gains of ``gains`` by bucket. It never
    holds much more than ``most`` nodes."""

    def __init__(self, buckets: int, gains: list[int] | None = None, most: int = 1_000_000):
        self.buckets, self.gains, self.most = buckets, gains, most
        self.totals = np.zeros(buckets, "i8")
        self._clear()

    def _clear(self) -> None:
        self.edges: dict[int, int] = {}
        self.registers, self.rests, self.values = [0], [b""], [0]

    def _new(self, at: int, byte: int, rest: bytes) -> int:
        """The node ``byte`` after ``at``, for a feature that goes on with ``rest``."""
        to = self.edges[at << 8 | byte] = len(self.registers)
        register = zlib.crc32(_ONE[byte], self.registers[at])
        self.registers.append(register)
        self.rests.append(rest)
        self.values.append(0 if self.gains is None else self.gains[zlib.crc32(rest, register) % self.buckets])
        return to

    def _split(self, at: int, rest: bytes) -> None:
        """The only feature that passed ``at`` moves on by a byte."""
        to = self._new(at, rest[0], rest[1:])
        self.values[to], self.rests[at] = self.values[at], b""
        self.values[at] = 0 if self.gains is None else self.gains[self.registers[at] % self.buckets]

    def node(self, feature: bytes) -> int:
        """The node of a feature, with those on the way to it."""
        step, rests, at, i = self.edges.get, self.rests, 0, 0
        for b in feature:
            if rest := rests[at]:
                if feature[i:] == rest:
                    return at
                self._split(at, rest)
            i += 1
            to = step(at << 8 | b)
            if to is None:
                return self._new(at, b, feature[i:])
            at = to
        if rests[at]:
            self._split(at, rests[at])
        return at

    def _long(self, feature: bytes) -> int:
        """The bucket of a feature beyond the trie's depth."""
        at = self.node(feature[:DEPTH])
        return zlib.crc32(feature[DEPTH:], zlib.crc32(self.rests[at], self.registers[at])) % self.buckets

    def add(self, features: Counter) -> None:
        node = self.node
        for feature, n in features.items():
            if len(feature) > DEPTH:
                self.totals[self._long(feature)] += n
            else:
                self.values[node(feature)] += n
            if len(self.registers) > self.most:
                self.empty()
                node = self.node

    def empty(self) -> None:
        """The counts go to the bucket totals."""
        ends = [zlib.crc32(rest, register) if rest else register for rest, register in zip(self.rests, self.registers)]
        np.add.at(self.totals, np.array(ends, "i8") % self.buckets, np.array(self.values, "i8"))
        self._clear()

    def gain(self, feature: bytes) -> int:
        if len(self.registers) > self.most:
            self._clear()
        return self.gains[self._long(feature)] if len(feature) > DEPTH else self.values[self.node(feature)]


def features(text: bytes | None, longest: int) -> tuple[int, list[bytes]]:
    """The number of words, and all runs of 1 to ``longest`` of them."""
    words = WORD.findall((text or b"").lower())  # of bytes: A to Z only
    if longest == 1:
        return len(words), words
    return len(words), [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _chunks(column: pa.Array, longest: int, most: int = 500_000):
    """(words, features) of each text, in lists of about ``most`` features."""
    out, size = [], 0
    for x in column:
        text = x.as_py()
        found = features(None if text is None else text.encode("utf-8", "surrogatepass"), longest)
        out.append(found)
        size += len(found[1]) + 1
        if size > most:
            yield out
            out, size = [], 0
    if out:
        yield out


def bucket_counts(docs: DataFrame, text_col: str, *, buckets: int, longest: int) -> DataFrame:
    """A row a task and bucket: bucket and n, from tries local to the tasks."""

    def count(batches):
        trie = WordTrie(buckets)
        for batch in batches:
            for chunk in _chunks(batch.column(0), longest):
                seen = Counter()
                for _, found in chunk:
                    seen.update(found)
                trie.add(seen)
        trie.empty()
        held = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(trie.totals[held], pa.int64())], ["bucket", "n"])

    return docs.select(text_col).mapInArrow(count, "bucket int, n long")


def gains(corpus: DataFrame, target: DataFrame, *, buckets: int, longest: int = 1, text_col: str = "text", target_col: str = "text") -> list[int]:
    """Every bucket's gain: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))."""
    s = bucket_counts(corpus, text_col, buckets=buckets, longest=longest).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    t = bucket_counts(target, target_col, buckets=buckets, longest=longest).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    merged = s.unionByName(t).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = np.zeros((buckets, 2), "i8")
    for r in merged.collect():
        totals[r.bucket] = r.s, r.t
    all_s, all_t = map(int, totals.sum(axis=0))
    return [math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets)))) for s, t in totals.tolist()]


def weighed(docs: DataFrame, by_bucket: list[int], *, longest: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` (whose columns must not be named as the three) with n_words, n_features and
    weight, the floored mean of its features' gains; 0 without any."""
    names = [c for c in docs.columns if c != text_col]

    def weigh(batches):
        trie = WordTrie(len(by_bucket), by_bucket)
        for batch in batches:
            rows = []
            for chunk in _chunks(batch.column(text_col), longest):
                known = {f: trie.gain(f) for f in {f for _, found in chunk for f in found}}
                rows += [(n, len(found), sum(map(known.__getitem__, found)) // len(found) if found else 0) for n, found in chunk]
            new = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new], [*names, "n_words", "n_features", "weight"])

    kinds = [T.StructField(c, docs.schema[c].dataType) for c in names] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    return docs.mapInArrow(weigh, T.StructType(kinds))


def noise(id_col: str | Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``: 1, 2, 3... in an order over all of them. They are sorted in
    ranges and written; a row's number is its place in its range after the ranges before."""
    rows = materialise(rows.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright(name, 33), F.col(name).bitwiseAND((1 << 33) - 1)
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("part")).agg(F.count("*")).collect())  # one a range
    before, offsets = 0, []
    for p, n in sizes:
        offsets.append((p, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, place + F.col("_before") + 1).drop("_part", "_before")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least_words: int = 20, buckets: int = 10_000, longest: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank (null: not drawn).

    Of the N rows with an id and at least ``least_words`` words, the floor(percent * N /
    100) highest scores are drawn; ties go to the smaller id, and of rows that share an id
    to any. Null texts have no words. A row without an id has no score and is not drawn. An
    empty target or corpus counts as one without features; an empty table gives no rows.
    Very long texts are read whole, and a long word is one feature. Other columns, of any
    name, are ignored."""
    by_bucket = gains(docs, target, buckets=buckets, longest=longest, text_col=text_col, target_col=target_col)
    found = weighed(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), by_bucket, longest=longest, text_col="_text")
    scored = found.withColumn("score", F.col("weight") + noise("_id", seed))
    scored = materialise(scored.withColumn("_row", F.monotonically_increasing_id()), "resampling")
    takes_part = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    by_score = sorted(map(tuple, scored.where(takes_part).groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    out = ["_id", "n_features", "weight", "score"]
    result = lambda rows, rank: rows.select(F.col("_id").alias(id_col), *out[1:], rank.alias("rank"))
    if not draw:
        return result(scored, F.lit(None).cast("long"))
    reached, cut = 0, 0
    for cut, n in by_score:
        reached += n
        if reached >= draw:
            break
    may = takes_part & (F.col("score") >= cut)
    first = ranked(scored.where(may).select(*out, "_row"), [F.desc("score"), F.asc("_id"), F.asc("_row")], "rank")
    rank = F.when(F.col("rank") <= draw, F.col("rank"))
    return result(first, rank).unionByName(result(scored.where(~F.coalesce(may, F.lit(False))), F.lit(None).cast("long")))


ORACLE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
per_doc AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY ALL),
words AS (
  SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
  FROM (SELECT word, n AS s, 0 AS t FROM per_doc UNION ALL SELECT word, 0, 1 FROM b) GROUP BY word),
bytes AS (SELECT *, hex(encode(word)) AS x FROM words),
hashed AS (
  SELECT word, s, t, xor(4294967295, list_reduce(
    list_concat([4294967295], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, v: xor(steps[xor(c & 255, v) + 1], c >> 8))) % 10000 AS bucket
  FROM bytes, crc_table),
bucket_totals AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM hashed),
bucket_gains AS (
  SELECT bucket, floor(1000 * ln((b.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((b.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE))) AS gain
  FROM bucket_totals b, totals a),
weights AS (
  SELECT doc_id, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM per_doc JOIN hashed USING (word) JOIN bucket_gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
    count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
