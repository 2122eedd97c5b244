"""Byte-level BPE: ranked merges folded by Spark's higher-order functions.

A Python stage cuts texts into pieces by the tokenizer's pattern and sends blocks of
whole documents on, each with its distinct pieces as byte arrays and every document as
numbers of pieces. Spark then folds the merges over each distinct piece: the state
holds the piece's ids and the rank of each neighbouring pair; a step replaces the
leftmost pair of lowest rank and looks up the two new neighbours. Long pieces hold the
same state in segments, so that a step copies little of it. Ranks come from a
literal map, laid out so that nearly every look is a single one (a map column would be
searched from end to end). Decoding concatenates the binary pieces of the ids. A last
stage puts the documents together. No text is shuffled and no stage holds more than its
block, so neither skewed sources nor lost executors matter.

Pieces that recur in a bounded sample of rows are folded once beforehand and sent around,
as most tasks would fold them anew; which they are changes the work and no result.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter, defaultdict
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import WS, _BYTE_PLAIN, _PLAIN

#: Above every rank: no such pair.
NONE = (1 << 17) - 1
TABLES = ("first", "second", "bytes", "pairs", "tokens")
#: Places of the map's tables; primes, so that pairs spread.
PRIMES = (230_003, 70_001)
#: A block of whole documents closes at so many characters.
BLOCK_CHARS = 1_500_000
#: Pieces a task keeps numbers for, besides the common ones.
KEEP_PIECES = 250_000
#: Rows sampled for the common pieces, and how many of these there are at most.
SAMPLE_ROWS, MOST_COMMON = 16_000, 400_000
#: Pieces folded in one row.
FOLD_PIECES = 4_000
#: A fold copies its state at every step, so the state of longer pieces is cut into
#: segments.
LONG_BYTES = 512


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_tables(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """Every mergeable pair of ids as ``pair << 18 | rank << 1 | more``: in the first
    table where its place is free, else in the second, at one of two places; ``more``
    marks a first place that some pair of the second table would have had."""
    first, second = [-2] * PRIMES[0], [-2] * (2 * PRIMES[1])
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is None or right is None:
                continue
            pair = left << 16 | right
            item, at = pair << 18 | rank << 1, pair % PRIMES[0]
            if first[at] < 0:
                first[at] = item
                continue
            first[at] |= 1
            for n in range(500):
                at = 2 * ((item >> 18) % PRIMES[1]) if n % 2 == 0 else 2 * (((item >> 18) + 7919 * (item >> 34)) % PRIMES[1]) + 1
                item, second[at] = second[at], item
                if item < 0:
                    break
            else:
                raise ValueError("no place for a pair; choose larger primes")
    return first, second


def literals(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row with the map's tables, the ids of bytes, the ranks of byte pairs and the
    bytes of ids."""
    first, second = rank_tables(ranks)
    of_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        of_id[rank] = token
    pairs = [ranks.get(bytes((a, b)), NONE) for a in range(256) for b in range(256)]
    row = (first, second, [ranks[bytes([b])] for b in range(256)], pairs, of_id)
    kinds = [pa.int64()] * 4 + [pa.binary()]
    return spark.createDataFrame(pa.table({n: pa.array([x], pa.list_(t)) for n, t, x in zip(TABLES, kinds, row)}))


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with a variable, by a fold over nothing."""
    return f"aggregate(array_repeat(0, 0), {value}, ({name}, _) -> {name}, {name} -> {body})"


def _rank(a: str, b: str) -> str:
    """The rank of a pair of ids; NONE also where one of them is null."""
    found = lambda x: f"shiftright({x}, 1) & {NONE}L"
    y, z = f"get(t_second, 2 * cast(k % {PRIMES[1]} as int))", f"get(t_second, 2 * cast((k + 7919 * shiftright(k, 16)) % {PRIMES[1]} as int) + 1)"
    rare = _bind(y, "y", f"IF(shiftright(y, 18) = k, {found('y')}, {_bind(z, 'z', f'IF(shiftright(z, 18) = k, {found("z")}, {NONE}L)')})")
    at_first = _bind(f"get(t_first, cast(k % {PRIMES[0]} as int))", "x", f"IF(shiftright(x, 18) = k, {found('x')}, IF(x & 1 = 1, {rare}, {NONE}L))")
    return _bind(f"{a} * 65536L + {b}", "k", at_first)


#: An element is rank << 40 | place << 16 | id: the id, the byte at which it starts, and
#: the rank of its pair with the next one, so that the least element is the leftmost pair
#: of lowest rank and is found without looking inside.
_PLACE = (1 << 40) - (1 << 16)
_SETTLED = f"{NONE << 40}L"
_NOTHING = "cast(array() as array<bigint>)"
_START = f"transform(w, (b, j) -> IF(j + 1 < size(w), get(t_pairs, b * 256 + get(w, j + 1)), {NONE}L) * {1 << 40}L + j * 65536L + get(t_bytes, b))"


def _merge(s: str, l: str) -> str:
    """Elements ``s`` after the pair that begins with element ``l`` has become one."""
    right = f"{_rank('m', f'(get({s}, q + 1) & 65535L)')} * {1 << 40}L + ({l} & {_PLACE}L) + m"
    left = _bind(f"get({s}, q - 2)", "u", f"{_rank('(u & 65535L)', 'm')} * {1 << 40}L + (u & {(1 << 40) - 1}L)")
    inside = f"concat(slice({s}, 1, q - 2), array({left}, {right}), slice({s}, q + 2, size({s})))"
    merged = f"IF(q > 1, {inside}, concat(array({right}), slice({s}, 3, size({s}))))"
    return _bind(f"shiftright({l}, 40)", "m", _bind(f"cast(array_position({s}, {l}) as int)", "q", merged))


def _flat_fold() -> str:
    """ids of the byte values ``w``; settled pieces pass the other steps by."""
    state = lambda s: _bind(s, "s", "struct(s AS s, array_min(s) AS l)")
    step = f"IF(t.l >= {_SETTLED}, t, {state(_merge('t.s', 't.l'))})"
    return f"aggregate(slice(w, 2, size(w)), {state(_START)}, (t, _) -> {step}, t -> transform(t.s, v -> cast(v & 65535L as int)))"


def _segment_fold() -> str:
    """The same for long pieces: the elements lie in segments of about the square root of
    their number, each with its least element, and a step rewrites only the segment of
    the pair and its neighbours. None is ever empty, so that two behind it hold what
    stands next to the pair. Gives the segments of ids."""
    segment = lambda s: _bind(s, "s", "struct(s AS s, array_min(s) AS l)")
    least = _bind("transform(g, x -> x.l)", "ls", _bind("array_min(ls)", "l", "struct(g AS g, l AS l, cast(array_position(ls, l) as int) AS p)"))
    state = lambda g: _bind(g, "g", least)
    width = "greatest(16, cast(sqrt(size(w)) as int))"
    begin = _bind(_START, "f", _bind(width, "n", f"transform(sequence(0, (size(f) - 1) div n), i -> {segment('slice(f, cast(i * n + 1 as int), n)')})"))
    window = f"struct(coalesce(get(t.g, t.p - 2).s, {_NOTHING}) AS a, get(t.g, t.p - 1).s AS b, coalesce(get(t.g, t.p).s, {_NOTHING}) AS c, coalesce(get(t.g, t.p + 1).s, {_NOTHING}) AS d)"
    sizes = "struct(size(o.a) AS a, size(o.b) - IF(inner, 1, 0) AS b, size(o.c) - IF(inner, 0, 1) AS c, size(o.d) AS d)"
    cuts = [("1", "z.a"), ("z.a + 1", "z.b"), ("z.a + z.b + 1", "z.c"), ("z.a + z.b + z.c + 1", "z.d")]
    pieces = "filter(array({}), x -> size(x) > 0)".format(", ".join(f"slice(r, {i}, {n})" for i, n in cuts))
    again = f"concat(slice(t.g, 1, greatest(0, t.p - 2)), transform({pieces}, e -> {segment('e')}), slice(t.g, t.p + 3, size(t.g)))"
    joined = _bind("concat(o.a, o.b, o.c, o.d)", "e", _merge("e", "t.l"))
    again = _bind(window, "o", _bind("array_position(o.b, t.l) < size(o.b)", "inner", _bind(sizes, "z", _bind(joined, "r", again))))
    step = f"IF(t.l >= {_SETTLED}, t, {state(again)})"
    return f"aggregate(slice(w, 2, size(w)), {state(begin)}, (t, _) -> {step}, t -> transform(t.g, x -> transform(x.s, v -> cast(v & 65535L as int))))"


def _with_tables(expression: str) -> str:
    """Columns that a lambda uses often are bound to variables; concat makes an object
    array of a table, whose elements are far quicker to get."""
    for column in TABLES:
        kind = "binary" if column == "tokens" else "bigint"
        expression = _bind(f"concat({column}, cast(array() as array<{kind}>))", f"t_{column}", expression)
    return expression


_DECODE = "aggregate(ids, cast('' as binary), (d, i) -> concat(d, get(t_tokens, i)))"


def _short_sql() -> str:
    """ids and decoded bytes of each of ``words``."""
    return _with_tables(f"transform(words, w -> {_bind(_flat_fold(), 'ids', f'struct(ids, {_DECODE} AS decoded)')})")


def _long_sql() -> str:
    """Place, ids and decoded bytes of each of ``long_words``, decoded a segment each first."""
    decoded = f"aggregate(transform(segments, ids -> {_DECODE}), cast('' as binary), (d, x) -> concat(d, x))"
    each = _bind(_segment_fold(), "segments", f"struct(v.at AS at, flatten(segments) AS ids, {decoded} AS decoded)")
    return _with_tables(f"transform(long_words, v -> {_bind('v.piece', 'w', each)})")


def _cutter(pattern: str):
    """A function from texts to pieces; most texts are cut by an equal, simpler pattern."""
    import regex

    exact = regex.compile(pattern)
    return lambda text: (_BYTE_PLAIN if text.isascii() or _PLAIN.fullmatch(text) else exact).findall(text)


def _blocks(batches, pattern: str, long_bytes: int, common: list[str]):
    """Documents cut into pieces, a row a block. Common pieces have the first numbers. A
    new piece is sent once: later blocks of the task refer to its number. At KEEP_PIECES
    known ones all but the first half, which has the frequent ones, are forgotten;
    ``keep`` tells the receiver how many stay."""
    import numpy as np

    cutter = _cutter(pattern)
    keys, docs, size, keep = [], [], 0, len(common)
    # a new piece takes the next number
    number = defaultdict(count(keep).__next__, zip(common, range(keep)))

    def row():
        words = [w.encode() for w in islice(number, keep, None)]
        short = [w if len(w) <= long_bytes else b"" for w in words]
        flat = np.frombuffer(b"".join(short), "u1").astype("i4")
        ends = np.cumsum([0] + [len(w) for w in short]).astype("i4")
        long_words = [(keep + i, np.frombuffer(w, "u1").astype("i4")) for i, w in enumerate(words) if len(w) > long_bytes]
        return pa.record_batch(
            [
                pa.array([keep], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([docs], pa.list_(pa.binary())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))),
                pa.array([long_words], pa.list_(pa.struct([("at", pa.int32()), ("piece", pa.list_(pa.int32()))]))),
            ],
            ["keep", "keys", "docs", "words", "long_words"],
        )

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = text or ""
            cut = cutter(text)
            keys.append(key)
            docs.append(np.fromiter(map(number.__getitem__, cut), "<u4", len(cut)).tobytes())
            size += len(text)
            if size >= BLOCK_CHARS:
                yield row()
                if len(number) >= len(common) + KEEP_PIECES:
                    kept = dict(islice(number.items(), len(common) + KEEP_PIECES // 2))
                    number = defaultdict(count(len(kept)).__next__, kept)
                keys, docs, size, keep = [], [], 0, len(number)
    if keys:
        yield row()


def _common(picked: DataFrame, tables: list[Column], pattern: str):
    """Pieces that recur in the sample, their ids and their decoded bytes. The sample's
    rows bound what is counted, and MOST_COMMON what reaches the driver."""
    n = picked.count()
    sample = picked.select("text").sample(min(1.0, SAMPLE_ROWS / max(1, n)), seed=7)

    def counted(batches):
        cutter, seen = _cutter(pattern), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(p for p in cutter(text or "") if len(p) <= 32)
        yield pa.record_batch([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])

    def grouped(batches):
        for b in batches:
            for i in range(0, b.num_rows, FOLD_PIECES):
                words = [w.encode() for w in b.column(0).slice(i, FOLD_PIECES).to_pylist()]
                yield pa.record_batch([pa.array([[list(w) for w in words]], pa.list_(pa.list_(pa.int32())))], ["words"])

    often = sample.mapInArrow(counted, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
    often = often.select("piece").limit(MOST_COMMON).mapInArrow(grouped, "words array<array<int>>")
    found = often.select("words", *tables).select(F.expr(_short_sql()).alias("pieces")).toArrow()
    ids, decoded = [], []
    for chunk in found.column("pieces").chunks:
        more = _folded(chunk.flatten())
        ids += more[0]
        decoded += more[1]
    return [d.decode() for d in decoded], ids, decoded


def _folded(pieces):
    """Ids (unsigned 32-bit) and decoded bytes of an array of folded pieces."""
    import numpy as np

    lists = pieces.field("ids")
    ids = np.asarray(lists.flatten()).astype("<u4").tobytes()
    ends = ((np.asarray(lists.offsets).astype("i8") - lists.offsets[0].as_py()) * 4).tolist()
    return [ids[i:j] for i, j in zip(ends[:-1], ends[1:])], pieces.field("decoded").to_pylist()


def encode_blocks(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES):
    """Blocks (keep, keys, docs, pieces: ids and decoded bytes of each new piece, and
    long_pieces: the same with the piece's number, for those whose place in ``pieces`` is
    empty), and a broadcast of the common pieces' ids and decoded bytes."""
    spark = docs.sparkSession
    view = "braidline_bpe_ranks"
    literals(spark, read_ranks(path)).createOrReplaceTempView(view)
    tables = [F.expr(f"(SELECT {c} FROM {view})").alias(c) for c in TABLES]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names, *encoded = _common(picked, tables, pattern)
    names, encoded = (spark.sparkContext.broadcast(x) for x in (names, encoded))
    schema = "keep long, keys array<long>, docs array<binary>, words array<array<int>>, long_words array<struct<at:int,piece:array<int>>>"
    blocks = picked.mapInArrow(lambda batches: _blocks(batches, pattern, long_bytes, names.value), schema)
    return blocks.select("*", *tables).select("keep", "keys", "docs", F.expr(_short_sql()).alias("pieces"), F.expr(_long_sql()).alias("long_pieces")), encoded


def _documents(blocks: DataFrame, common, make, schema: str) -> DataFrame:
    """Rows of ``make(keys, [(ids bytes, decoded bytes)])`` for each block."""

    def run(batches):
        import numpy as np

        encoded, decoded = map(list, common.value)
        for b in batches:
            for r in range(b.num_rows):
                keep = b.column(0)[r].as_py()
                del encoded[keep:], decoded[keep:]
                more = _folded(b.column(3).slice(r, 1).flatten())
                encoded += more[0]
                decoded += more[1]
                for x in b.column(4)[r].as_py():
                    encoded[x["at"]] = np.array(x["ids"], "<u4").tobytes()
                    decoded[x["at"]] = x["decoded"]
                out = []
                for doc in b.column(2)[r].as_py():
                    at = np.frombuffer(doc, "<u4").tolist()
                    out.append((b"".join(map(encoded.__getitem__, at)), b"".join(map(decoded.__getitem__, at))))
                yield make(b.column(1)[r].as_py(), out)

    return blocks.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, **cols) -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian) and decoded bytes of every text.
    Null texts count as empty and give no ids; repeated rows each give their own."""

    def make(keys, found):
        return pa.record_batch(
            [pa.array(keys, pa.int64()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())],
            ["doc_id", "ids", "decoded"],
        )

    return _documents(*encode_blocks(docs, path, pattern, **cols), make, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, **cols) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. Null texts count as empty (the digests
    of nothing), repeated rows and null ids give a row each, an empty table none."""

    def make(keys, found):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.record_batch(
            [pa.array(keys, pa.int64()), pa.array([len(x) // 4 for x, _ in found], pa.int64()), pa.array([sha(x) for x, _ in found]), pa.array([sha(y) for _, y in found])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _documents(*encode_blocks(docs, path, pattern, **cols), make, schema)
