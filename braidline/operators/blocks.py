"""Counts of common tokens between many sets, a block of sets against a block at a time.

Where a few tokens are in most sets, nearly every pair of sets shares some, and a join by
token lists each pair again and again. Here blocks of sets meet as a whole: a task counts a
pair of blocks by matrix products over the tokens that both have, and gives only the pairs
that are asked for. No pair is listed by token, exchanged or made distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise

#: Sets that are multiplied at once, and tokens: 16 and 32 MB of floats.
SETS, TOKENS = 2048, 4096
#: Blocks at most, as every set is sent to each; a block of more sets is taken in parts.
BLOCKS = 64


def coded(rows: DataFrame, token: str) -> DataFrame:
    """Rows with ``_c``, a number for each token; rows without one go."""
    codes = rows.where(F.col(token).isNotNull()).select(token).distinct().withColumn("_c", F.monotonically_increasing_id())
    return rows.join(materialise(codes, "codes"), token)


def _counts(a: list, b: list) -> np.ndarray:
    """Of every two of these arrays of codes, how often codes of one meet those of the other."""
    n = lambda sets: max((len(s) for s in sets), default=0)
    kind = np.float32 if n(a) * n(b) < 1 << 24 else np.float64
    flat = lambda sets: np.concatenate([np.asarray(s, np.int64) for s in sets]) if sets else np.zeros(0, np.int64)
    both = np.intersect1d(flat(a), flat(b))
    out = np.zeros((len(a), len(b)), kind)

    def dense(sets, codes):
        x, all_ = np.zeros((len(sets), len(codes)), kind), flat(sets)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(codes, all_), len(codes) - 1)
        held = codes[at] == all_
        np.add.at(x, (row[held], at[held]), 1)
        return x

    for i in range(0, len(both), TOKENS):
        codes = both[i : i + TOKENS]
        out += dense(a, codes) @ dense(b, codes).T
    return out


def block_pairs(sets: DataFrame, key: str, keep: Callable, *, other: str | None = None, loops: bool = False) -> DataFrame:
    """a, b, size_a, size_b, common of pairs of ``sets`` (key, codes), a < b, or a = b too
    with ``loops``, for which ``keep(common, size_a, size_b)`` (arrays that broadcast) holds.
    Codes may recur and then count as often. With ``other``, the codes of one set meet that
    column's of the other; this must be the same either way round."""
    columns = ["codes"] if other is None else ["codes", other]
    found = materialise(sets.select(F.col(key).alias("key"), *columns), "sets")
    blocks = min(BLOCKS, max(1, -(-found.count() // SETS)))
    rows = found.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    rows = rows.select("key", *columns, "_b", F.explode(meets).alias("p")).select("key", *columns, "_b", "p.i", "p.j")
    kind = found.schema["key"].dataType
    last = columns[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        b = t["_b"].to_numpy()
        sides = [t.filter(pa.array(b == i))] if i == j else [t.filter(pa.array(b == i)), t.filter(pa.array(b == j))]
        if len(sides) == 2 and not (len(sides[0]) and len(sides[1])):
            return
        x, y = sides[0], sides[-1]
        for s in range(0, len(x), SETS):
            for r in range(s if i == j else 0, len(y), SETS):
                p, q = x.slice(s, SETS), y.slice(r, SETS)
                ca, cb = p["codes"].to_numpy(), q[last].to_numpy()
                na, nb = np.array([len(c) for c in ca], np.int64), np.array([len(c) for c in cb], np.int64)
                n = _counts(list(ca), list(cb))
                good = keep(n.astype(np.float64), na[:, None], nb[None])
                if i == j and s == r:
                    good = np.triu(good, 0 if loops else 1)
                at, to = np.nonzero(good)
                ka, kb = p["key"].combine_chunks(), q["key"].combine_chunks()
                for k in range(0, len(at), 1 << 18):
                    u, v = at[k : k + (1 << 18)], to[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays(
                        [ka.take(pa.array(u)), kb.take(pa.array(v)), pa.array(na[u]), pa.array(nb[v]), pa.array(n[u, v].astype(np.int64))], names=["a", "b", "size_a", "size_b", "common"]
                    )

    # long work on few bytes: spread by pairs of blocks and cores, not by bytes
    spark = sets.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = rows.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, f"a {kind.simpleString()}, b {kind.simpleString()}, size_a long, size_b long, common long")
    turned = F.col("a") > F.col("b")
    swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
    return met.select(swap("a", "b"), swap("b", "a"), swap("size_a", "size_b"), swap("size_b", "size_a"), "common")


#: Pairs of keys that leave a task at once.
LEAVING = 1 << 18


def _leave(x, y, at, to, value, name: str, kinds, by_first: bool, loops: bool = False, own=None, both: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches (a, b, name) of all pairs of keys of x's rows ``at`` with those of y's rows
    ``to``, a slice of pairs of rows at a time; of a row with itself (``own``) each pair
    once. ``x``, ``y``: keys of all rows behind one another, and how many each has."""
    (xk, xn), (yk, yn) = x, y
    xs, ys = np.cumsum(xn) - xn, np.cumsum(yn) - yn
    many = xn[at] * yn[to]
    slot = np.cumsum(many) // LEAVING
    for s, e in zip(*(lambda c: (np.concatenate([[0], c]), np.concatenate([c, [len(at)]])))(np.flatnonzero(np.diff(slot)) + 1)):
        if s == e:
            continue
        m, width = many[s:e], yn[to[s:e]]
        pair = np.repeat(np.arange(e - s), m)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)
        w = width[pair]
        row = k // w
        column = k - row * w
        u, v = xs[at[s:e]][pair] + row, ys[to[s:e]][pair] + column
        if own is not None and own[s:e].any():
            good = ~own[s:e][pair] | ((row <= column) if loops else (row < column))
            pair, u, v = pair[good], u[good], v[good]
        a, b = xk.take(pa.array(u)), yk.take(pa.array(v))
        if pa.types.is_integer(kinds[0]) and not by_first and not both:
            n, m = a.to_numpy(), b.to_numpy()
            a, b = pa.array(np.minimum(n, m)), pa.array(np.maximum(n, m))
        if both:
            apart = pa.array(np.flatnonzero(u != v) if own is not None and own[s:e].any() else np.arange(len(u)))
            a, b = pa.concat_arrays([a, b.take(apart)]), pa.concat_arrays([b, a.take(apart)])
        columns = [a, b] if value is None else [a, b, pa.array(value[s:e][pair], kinds[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"] if value is None else ["a", "b", name])


def _keys_of(t):
    c = t["keys"].combine_chunks()
    return c.flatten(), np.diff(c.offsets.to_numpy()).astype(np.int64)


def _ordered(df: DataFrame, name: str, by_size: bool) -> DataFrame:
    if by_size or df.schema["a"].dataType.typeName() == "long":
        return df
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), name)


def _dealt(rows: DataFrame, columns: list[str], by: str) -> tuple[DataFrame, int]:
    """Rows sent to every pair of blocks that theirs is of (_b, i, j), and how many tasks."""
    spark = rows.sparkSession
    # keys make more pairs than bytes tell, so a block's rows and keys are few
    n, keys = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    blocks = min(BLOCKS, max(1, -(-n // 256), -(-keys // 512)))
    out = rows.withColumn("_b", F.pmod(F.xxhash64(by), F.lit(blocks)).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    out = out.select(*columns, "_b", F.explode(meets).alias("p")).select(*columns, "_b", "p.i", "p.j")
    return out, max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * (blocks + 1) // 2)


def key_pairs(rows: DataFrame, keep: Callable, value: Callable, kind: str, name: str, *, by_size: bool = False) -> DataFrame:
    """a, b, ``name`` of all pairs of keys of ``rows`` (keys, codes, size: keys that have
    equal sets), where keep(common, size_a, size_b) holds: value(the same). a < b, or
    ``by_size`` a is of the smaller set. A pair of sets is counted once for all their keys,
    and their pairs leave the task as they are made: nothing is exchanged by pair."""
    rows = materialise(rows.withColumn("_id", F.monotonically_increasing_id()), "alike-rows")
    sent, tasks = _dealt(rows, ["_id", "keys", "codes", "size"], "_id")
    key = rows.schema["keys"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j, b = t["i"][0].as_py(), t["j"][0].as_py(), t["_b"].to_numpy()
        x, y = t.filter(pa.array(b == i)), t.filter(pa.array(b == j))
        kinds = (t.schema.field("keys").type.value_type, pa.int64() if kind == "long" else pa.float64())
        for s in range(0, len(x), SETS):
            for r in range(s if i == j else 0, len(y), SETS):
                p, q = x.slice(s, SETS), y.slice(r, SETS)
                n = _counts(list(p["codes"].to_numpy()), list(q["codes"].to_numpy())).astype(np.float64)
                na, nb = p["size"].to_numpy()[:, None].astype(float), q["size"].to_numpy()[None].astype(float)
                good = keep(n, na, nb)
                if i == j and s == r:
                    good = np.triu(good)
                at, to = np.nonzero(good)
                if by_size:
                    turn = na[at, 0] > nb[0, to]
                for back in (False, True) if by_size else (None,):
                    f, g = (at, to) if back is None else (at[turn == back], to[turn == back])
                    v = value(n[f, g], na[f, 0], nb[0, g])
                    sides = ((_keys_of(p), f), (_keys_of(q), g))
                    (kx, f2), (ky, g2) = sides[::-1] if back else sides
                    own = f == g if i == j and s == r else None
                    yield from _leave(kx, ky, f2, g2, v, name, kinds, by_size, own=own)

    out = sent.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(run, f"a {key.simpleString()}, b {key.simpleString()}, {name} {kind}")
    return _ordered(out, name, by_size)


def expanded(pairs: DataFrame, parts: DataFrame, keep: Callable, value: Callable, kind: str, name: str, *, by_size: bool = False) -> DataFrame:
    """The same from listed pairs of sets (a, b, size_a, size_b, common; a set with itself
    too) and parts of the sets' keys (set, part, keys)."""
    parts = materialise(parts, "alike-parts")
    x, y = (parts.select(F.col("set").alias(c), F.col("part").alias(f"p{c}"), F.col("keys").alias(f"k{c}")) for c in "ab")
    met = pairs.join(x, "a").join(y, "b").where("a <> b OR pa <= pb")
    key = parts.schema["keys"].dataType.elementType

    def run(batches):
        for t in batches:
            kinds = (t.schema.field("ka").type.value_type, pa.int64() if kind == "long" else pa.float64())
            n, na, nb = (t.column(c).to_numpy().astype(float) for c in ("common", "size_a", "size_b"))
            at = np.flatnonzero(keep(n, na, nb))
            own = ((t.column("a").to_numpy() == t.column("b").to_numpy()) & (t.column("pa").to_numpy() == t.column("pb").to_numpy()))[at]
            sides = [(t.column(c).flatten(), np.diff(t.column(c).offsets.to_numpy()).astype(np.int64)) for c in ("ka", "kb")]
            yield from _leave(*sides, at, at, value(n, na, nb)[at], name, kinds, by_size, own=own)

    met = met.select("a", "b", "pa", "pb", "size_a", "size_b", "common", "ka", "kb")
    return _ordered(met.mapInArrow(run, f"a {key.simpleString()}, b {key.simpleString()}, {name} {kind}"), name, by_size)


def _touching(a: list, b: list) -> np.ndarray:
    """Which of these sets of codes meet: a code's holders in b as bits, joined for each of a."""
    n = lambda sets: np.array([len(s) for s in sets], np.int64)
    flat = lambda sets: np.concatenate([np.zeros(0, np.int64), *(np.asarray(s, np.int64) for s in sets)])
    x, y, of, at = flat(a), flat(b), np.repeat(np.arange(len(a)), n(a)), np.repeat(np.arange(len(b)), n(b))
    both, out = np.intersect1d(x, y), np.zeros((len(a), -(-len(b) // 8)), np.uint8)
    for s in range(0, len(both), TOKENS):
        codes = both[s : s + TOKENS]

        def held(codes_of, row):
            i = np.minimum(np.searchsorted(codes, codes_of), len(codes) - 1)
            ok = codes[i] == codes_of
            return i[ok], row[ok]

        holders = np.zeros((len(codes), len(b)), bool)
        holders[held(y, at)] = True
        bits = np.packbits(holders, axis=1)
        i, row = held(x, of)
        for k in range(0, len(i), 1 << 17):
            rows, begin = np.unique(row[k : k + (1 << 17)], return_index=True)
            out[rows] |= np.bitwise_or.reduceat(bits[i[k : k + (1 << 17)]], begin, axis=0)
    return np.unpackbits(out, axis=1, count=len(b)).view(bool)


#: Sets of a block of ``touching`` at most, while blocks are fewer than BLOCKS.
WIDE = 1 << 16


def touching(sets: DataFrame, key: str) -> DataFrame:
    """key, other: keys of ``sets`` (key, codes) that have a code in common, both ways round
    and each with itself. Blocks of sets meet as bits; a pair leaves the task once."""
    found = materialise(sets.select(F.col(key).alias("key"), F.transform("codes", lambda c: c.cast("long")).alias("codes")), "sets")
    spark = sets.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = found.count()
    # every set is sent to each block: no more of them than give each core its tasks
    blocks = max(1, min(BLOCKS, -(-n // SETS), max(int(np.ceil(np.sqrt(2 * tasks))), -(-n // WIDE))))
    rows = found.withColumn("_b", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    rows = rows.select("key", "codes", "_b", F.explode(meets).alias("p")).select("key", "codes", "_b", "p.i", "p.j")
    kind = found.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        i, j, b = t["i"][0].as_py(), t["j"][0].as_py(), t["_b"].to_numpy()
        x, y = t.filter(pa.array(b == i)), t.filter(pa.array(b == j))
        for s in range(0, len(x), SETS):
            for r in range(s if i == j else 0, len(y), SETS):
                p, q = x.slice(s, SETS), y.slice(r, SETS)
                at, to = np.nonzero(_touching(list(p["codes"].to_numpy()), list(q["codes"].to_numpy())))
                ka, kb = p["key"].combine_chunks(), q["key"].combine_chunks()
                for k in range(0, len(at), LEAVING):
                    u, v = ka.take(pa.array(at[k : k + LEAVING])), kb.take(pa.array(to[k : k + LEAVING]))
                    yield pa.RecordBatch.from_arrays([u, v], names=[key, "other"])
                    if i != j or s != r:
                        yield pa.RecordBatch.from_arrays([v, u], names=[key, "other"])

    return rows.repartition(max(tasks, blocks * (blocks + 1) // 2), "i", "j").groupBy("i", "j").applyInArrow(run, f"{key} {kind}, other {kind}")


def code_sets(rows: DataFrame, key: str, token: str) -> DataFrame:
    """key, codes: the distinct tokens of each key, as numbers."""
    return coded(rows.select(key, token).distinct(), token).groupBy(key).agg(F.collect_list("_c").alias("codes"))
