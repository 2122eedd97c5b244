"""Repeated passages by recompression: rounds name runs and pairs of tokens, until equal
passages are equal symbols.

A round of runs replaces every maximal run of one symbol by a name for (symbol, length); a
round of pairs splits all symbols into left and right ones, by a bit of their names, and
replaces every left symbol and the right one behind it by a name for the two. A name is a
hash of what it stands for, so that it is the same in every document and task without an
exchange. Where a passage occurs twice, both occurrences are named alike but near their
ends: after each round the symbols that no neighbour outside can have changed are known
from the passage alone.

Two kinds of symbols go through a Spark round that counts each name over all documents:

* of each window, a symbol and the next one of its interior: the least two by hash among
  those left when another round would leave none (or the only one left). Equal windows
  choose the same, so a window whose choice occurs once is unique;
* high-level symbols of at least a window's words, wherever a round made one that is twice
  as long as its parts' class (20 to 39 words, 40 to 79...), and the one left of a whole
  text. They are verified by length and a digest of their words. All windows within one
  that also starts earlier are repeats, at once.

The windows left over (their choice is shared, and no repeated high-level symbol covers
them) are compared by two digests of their words, 96 bits together: first with those of
their own text, then, one of each, with all others.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

#: White space that separates words, in UTF-8.
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are tokenised in stretches of so many bytes, cut at white space; longer words are
#: hashed by themselves.
STRETCH = 1 << 20
LONG_WORD = 4096
#: A longer text is parsed in pieces of so many words, each with a window less a word more.
PIECE = 1 << 18
#: Words parsed at once.
AT_ONCE = 1 << 18
#: Rounds in which windows look for their symbol: runs of words, then pairs.
ANCHOR_ROUNDS = 5
_M = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, "u8")

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, "u8")
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype="u8"))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of values times the powers of their places."""
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, "u8")
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def digests(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the values between starts and ends, wherever they stand."""
        return _mix((sums[ends] - sums[starts]) * self.down[starts])


_BYTES = (Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F))
_WORDS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))


def _stretch_hashes(data: bytes) -> np.ndarray:
    """Two hashes of each word of ``data``, as rows."""
    b = np.frombuffer(data, "u1")
    edge = np.flatnonzero(np.diff(_IS_SPACE[b].astype("i1"), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    values = b.astype("u8") + np.uint64(1)
    out = np.stack([p.digests(p.sums(values), starts, ends) for p in _BYTES])
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        out[:, i] = np.frombuffer(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest(), "<u8")
    return out


def word_hashes(data: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word of a text."""
    if len(data) <= STRETCH:
        return _stretch_hashes(data)
    found, at = [], 0
    while at < len(data):
        end = at + STRETCH
        if end < len(data):
            cut = max(data.rfind(bytes([c]), at, end) for c in (9, 10, 11, 12, 13, 32))
            if cut < 0:  # one word to the end of the stretch and beyond
                m = _SPACE.search(data, end)
                end = m.start() if m else len(data)
                found.append(np.frombuffer(hashlib.blake2b(data[at:end], digest_size=16).digest(), "<u8").reshape(2, 1))
                at = end
                continue
            end = cut + 1
        found.append(_stretch_hashes(data[at:end]))
        at = end
    return np.concatenate(found, axis=1)


def _class(size: np.ndarray, window: int) -> np.ndarray:
    """0 below a window's words, then one more for each doubling."""
    out = np.zeros(len(size), "i8")
    long = np.flatnonzero(size >= window)
    out[long] = np.frexp(size[long] / window)[1]
    return out


class Parse:
    """Pieces of word hashes, in one row of words, through all rounds."""

    def __init__(self, pieces: list[np.ndarray], window: int):
        self.window = window
        self.sizes = np.array([p.shape[1] for p in pieces], "i8")
        self.first = np.cumsum(self.sizes) - self.sizes
        self.words = np.concatenate(pieces, axis=1) if pieces else np.zeros((2, 0), "u8")
        self.piece = np.repeat(np.arange(len(pieces)), self.sizes)
        self.sums = [p.sums(w) for p, w in zip(_WORDS, self.words)]
        self._rounds()

    def window_digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the windows with these numbers: 64 and 32 bits."""
        starts = self.starts[at]
        one, two = (p.digests(s, starts, starts + self.window) for p, s in zip(_WORDS, self.sums))
        return one.view("i8"), (two >> np.uint64(32)).astype("u4").view("i4")

    def _settle(self, who, lo, hi, name, start) -> None:
        """The windows ``who`` take the least two neighbours of their symbols lo to hi."""
        if not len(who):
            return
        two = hi - lo > 1
        # one symbol and two neighbours are named apart
        both = _mix(name * np.uint64(3) + _mix(np.append(name[1:], np.uint64(0))))
        at, best = lo.copy(), np.where(two, both[lo], _mix(name[lo]))
        for j in range(1, int((hi - lo).max()) - 1):
            more = np.minimum(lo + j, np.maximum(hi - 2, lo))
            less = two & (both[more] < best)
            at, best = np.where(less, more, at), np.where(less, both[more], best)
        self.anchor[who], self.anchor_at[who] = best, start[at]

    def _rounds(self) -> None:
        n, k = self.words.shape[1], self.window
        own, name, start = self.piece, self.words[0], np.arange(n)
        end_of = np.append(self.first[1:], n)
        #: Where windows start, and what each one chose: its name and first word.
        self.starts = np.flatnonzero(own[: max(n - k + 1, 0)] == own[k - 1 :]) if n >= k else np.zeros(0, "i8")
        self.anchor, self.anchor_at = np.zeros(len(self.starts), "u8"), np.zeros(len(self.starts), "i8")
        who, lo = np.arange(len(self.starts)), self.starts.copy()
        hi = lo + k
        high, cls, idle, t = [], np.zeros(n, "i8"), 0, 0
        while True:
            runs = t == 0 or (t >= ANCHOR_ROUNDS and t % 2 == 0)
            same = own[1:] == own[:-1]
            if runs:
                goes = np.append(False, same & (name[1:] == name[:-1]))
            else:
                right = (_mix(name + np.uint64((t * 0x9E3779B97F4A7C15) & _M)) >> np.uint64(63)).astype(bool)
                goes = np.append(False, same & ~right[:-1] & right[1:])
            keep = np.flatnonzero(~goes)
            to = np.cumsum(~goes) - 1
            if runs:
                length = np.diff(np.append(keep, len(name)))
                new = np.where(length > 1, _mix(_mix(name[keep]) + length.astype("u8") * np.uint64(0xFF51AFD7ED558CCD)), name[keep])
            else:
                second = name[np.minimum(keep + 1, len(name) - 1)]
                paired = np.append(goes[1:], False)[keep]
                new = np.where(paired, _mix(name[keep] * np.uint64(0xC4CEB9FE1A85EC53) + _mix(second ^ np.uint64(0x51AFD7ED558CCD))), name[keep])
            if t < ANCHOR_ROUNDS:
                if runs:
                    lo1, hi1 = to[lo] + 1, to[hi - 1]
                else:
                    lo1, hi1 = lo + right[lo], hi - ~right[hi - 1]
                    some = lo1 < hi1
                    lo1, hi1 = np.where(some, to[np.minimum(lo1, len(to) - 1)], 0), np.where(some, to[hi1 - 1] + 1, 0)
                left = lo1 < hi1
                self._settle(who[~left], lo[~left], hi[~left], name, start)
                who, lo, hi = who[left], lo1[left], hi1[left]
            merged = len(keep) < len(name)
            name, start, own = new, start[keep], own[keep]
            end = np.append(start[1:], n)
            end = np.minimum(end, end_of[own]) if len(own) else end
            size = end - start
            # a part's class is at most that of the longest of its parts
            part = np.maximum.reduceat(cls, keep) if cls.any() else cls[keep]
            cls = _class(size, k)
            made = np.flatnonzero(cls > part)
            high.append((name[made], start[made], size[made]))
            t += 1
            if t == ANCHOR_ROUNDS:
                self._settle(who, lo, hi, name, start)
            idle = 0 if merged else idle + 1
            if t >= ANCHOR_ROUNDS and (idle >= 12 or len(name) == len(self.sizes)):
                break
        whole = np.flatnonzero((size == self.sizes[own]) & (size >= k)) if n else np.zeros(0, "i8")
        high.append((name[whole], start[whole], size[whole]))
        names, starts, sizes = (np.concatenate(x) for x in zip(*high))
        _, once = np.unique(starts * (1 << 32) + sizes, return_index=True)
        #: High-level symbols: name, first word, words.
        self.high, self.high_at, self.high_size = names[once], starts[once], sizes[once]
        self.high_check = _WORDS[1].digests(self.sums[1], self.high_at, self.high_at + self.high_size)

    def symbols(self, who: np.ndarray):
        """What is counted: name, check, size, number and row, one for each name and row.
        Windows' choices have check and size 0. ``who``: the row of each piece."""
        new = lambda at, name: np.append(True, (at[1:] != at[:-1]) | (name[1:] != name[:-1]))[: len(at)]
        once = new(self.anchor_at, self.anchor)  # neighbours mostly choose alike
        at, name = self.anchor_at[once], self.anchor[once]
        order = np.lexsort((name, at))
        at, name = at[order], name[order]
        once = new(at, name)
        at, name = at[once], name[once]
        zero = np.zeros(len(at), "i8")
        name = np.concatenate([name.view("i8"), self.high.view("i8")])
        check = np.concatenate([zero, self.high_check.view("i8")])
        size = np.concatenate([zero, self.high_size])
        row = who[self.piece[np.concatenate([at, self.high_at])]]
        order = np.lexsort((name, row))
        label = np.stack([row, name, check, size])[:, order]
        head = np.flatnonzero(np.append(True, (label[:, 1:] != label[:, :-1]).any(axis=0))) if len(order) else order
        n = np.diff(np.append(head, len(order)))
        row, name, check, size = label[:, head]
        return name, check, size, n, row


def _texts(column) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _parses(rows, window: int):
    """Parses of about ``AT_ONCE`` words. ``rows``: (number, word hashes). Each parse comes
    with its pieces' row numbers and the place of their first word in the text."""
    pieces, who, base, held = [], [], [], 0
    for number, words in rows:
        n = words.shape[1]
        for at in range(0, n, PIECE):
            if n - at < window:
                break
            pieces.append(words[:, at : at + PIECE + window - 1])
            who.append(number)
            base.append(at)
            held += pieces[-1].shape[1]
            if held >= AT_ONCE:
                yield Parse(pieces, window), np.array(who), np.array(base)
                pieces, who, base, held = [], [], [], 0
    if pieces:
        yield Parse(pieces, window), np.array(who), np.array(base)


def _columns(batch, names, rows) -> list[pa.Array]:
    take = pa.array(rows, pa.int64())
    return [batch.column(c).take(take) for c in names]


def symbols(docs: DataFrame, window: int) -> DataFrame:
    """``docs``: _id and _text. A row a counted symbol of a text: name, check, size and how
    often it occurs there."""

    def parse(batches):
        for batch in batches:
            rows = ((i, word_hashes(x)) for i, x in enumerate(_texts(batch.column("_text"))))
            for found, who, _ in _parses(rows, window):
                name, check, size, n, row = found.symbols(who)
                yield pa.RecordBatch.from_arrays([*_columns(batch, ["_id"], row), *map(pa.array, (name, check, size.astype("i4"), n.astype("i4")))], ["_id", "name", "check", "size", "n"])

    out = T.StructType([docs.schema["_id"]])
    for c, kind in (("name", T.LongType()), ("check", T.LongType()), ("size", T.IntegerType()), ("n", T.IntegerType())):
        out = out.add(c, kind)
    return docs.select("_id", "_text").mapInArrow(parse, out)


def _later(id_col: str, least: str) -> Column:
    """Whether a row comes after the first one: those without an id come last."""
    return (F.col(id_col) > F.col(least)) | (F.col(id_col).isNull() & F.col(least).isNotNull())


class _Own:
    """The windows of one text after another: which ones are repeats within their text."""

    def __init__(self):
        self.row, self.keys = -1, np.zeros(0, [("one", "i8"), ("two", "i4")])

    def again(self, row, one, two, at) -> np.ndarray:
        keys = np.zeros(len(row), self.keys.dtype)
        keys["one"], keys["two"] = one, two
        order = np.lexsort((at, two, one, row))
        same = (row[order][1:] == row[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        out = np.zeros(len(row), bool)
        out[order[1:][same]] = True
        if len(row):
            goes_on = row == self.row  # a long text that the parse before began
            out[goes_on] |= np.isin(keys[goes_on], self.keys)
            last = keys[row == row[-1]]
            self.keys = np.concatenate([self.keys, last]) if row[-1] == self.row else last
            self.row = row[-1]
        return out


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


#: What a parsed text gives: its result where no window is left to compare, else the text
#: with the stretches known to be repeats; and a row a window to compare.
_PARTS = "n_words long, sha string, text string, covered array<long>, at long, one long, two int"


def windows(marked: DataFrame, window: int) -> DataFrame:
    """``marked``: _id, _twin, _text, names (of shared symbols, sorted) and earlier
    (whether a smaller id has it)."""

    def shared(names, sought):
        at = np.minimum(np.searchsorted(names, sought), len(names) - 1)
        return at, names[at] == sought

    def parse(batches):
        for batch in batches:
            ids, text = batch.column("_id"), _texts(batch.column("_text"))
            lists = [batch.column(c).to_pylist() for c in ("names", "earlier")]
            covered: dict[int, list[int]] = {}
            own, last, its = _Own(), -1, np.zeros(0, "u8")
            rows = ((i, word_hashes(text[i])) for i, x in enumerate(lists[0]) if x)
            for found, who, base in _parses(rows, window):
                hit = np.zeros(len(found.starts), bool)
                over = np.zeros(len(found.piece) + 1, "i8")  # covered starts of windows, by steps
                by_piece = np.argsort(found.piece[found.high_at], kind="stable")
                high_ends = np.searchsorted(found.piece[found.high_at][by_piece], np.arange(len(who) + 1))
                window_ends = np.searchsorted(found.piece[found.starts], np.arange(len(who) + 1))
                for p, i in enumerate(who):
                    names, earlier = np.array(lists[0][i], "i8"), np.array(lists[1][i], bool)
                    mine = by_piece[high_ends[p] : high_ends[p + 1]]  # in order of place
                    at, is_shared = shared(names, found.high[mine].view("i8"))
                    place = found.high_at[mine] - found.first[p] + base[p]
                    new = np.zeros(len(mine), bool)
                    new[np.unique(found.high[mine], return_index=True)[1]] = True
                    if i == last:  # a further piece of a long text
                        new &= ~np.isin(found.high[mine], its)
                    its = np.concatenate([its, found.high[mine]]) if i == last else found.high[mine]
                    last = i
                    later = is_shared & (earlier[at] | ~new)
                    for s, n, x in zip(found.high_at[mine][later], found.high_size[mine][later], place[later]):
                        over[s] += 1
                        over[s + n - window + 1] -= 1
                        covered.setdefault(i, []).extend((int(x), int(x + n)))
                    a, b = window_ends[p], window_ends[p + 1]
                    hit[a:b] = shared(names, found.anchor[a:b].view("i8"))[1]
                left = np.flatnonzero(hit & (np.cumsum(over)[found.starts] == 0))
                one, two = found.window_digests(left)
                piece = found.piece[found.starts[left]]
                row, at = who[piece], found.starts[left] - found.first[piece] + base[piece]
                again = own.again(row, one, two, at)
                for i in np.unique(row).tolist():
                    covered.setdefault(i, [])
                for i, x in zip(row[again].tolist(), at[again].tolist()):
                    covered[i] += (x, x + window)
                row, at, one, two = (v[~again] for v in (row, at, one, two))
                n = len(row)
                none = lambda kind: pa.nulls(n, kind)
                yield pa.RecordBatch.from_arrays(
                    [*_columns(batch, ["_id", "_twin"], row), none(pa.int64()), none(pa.string()), none(pa.string()), none(pa.list_(pa.int64())), *map(pa.array, (at, one, two))],
                    ["_id", "_twin", "n_words", "sha", "text", "covered", "at", "one", "two"],
                )
            words = [None if i in covered else x.split() for i, x in enumerate(text)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, batch.column("_twin"),
                    pa.array([None if w is None else len(w) for w in words], pa.int64()), pa.array([None if w is None else _digest(w) for w in words], pa.string()),
                    pa.array([x.decode("utf-8", "surrogatepass") if w is None else None for x, w in zip(text, words)], pa.string()),
                    pa.array([covered.get(i) for i in range(n)], pa.list_(pa.int64())), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()),
                ],
                ["_id", "_twin", "n_words", "sha", "text", "covered", "at", "one", "two"],
            )

    keys = ", ".join(f"{c} {marked.schema[c].dataType.simpleString()}" for c in ("_id", "_twin"))
    return marked.select("_id", "_twin", "_text", "names", "earlier").mapInArrow(parse, f"{keys}, {_PARTS}")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """``found``: _id, text, covered (pairs of first word and end) and starts (of repeated
    windows) to _id, n_words, n_removed, kept_text."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, covered, starts in zip(_texts(batch.column("text")), batch.column("covered").to_pylist(), batch.column("starts").to_pylist()):
                words = text.split()
                steps = np.zeros(len(words) + 1, "i8")
                for a, b in zip((covered or [])[::2], (covered or [])[1::2]):
                    steps[a] += 1
                    steps[b] -= 1
                at = np.array(starts or [], "i8")
                np.add.at(steps, at, 1)
                np.add.at(steps, at + window, -1)
                stay = np.cumsum(steps[:-1]) == 0
                kept = [words[i] for i in np.flatnonzero(stay)]
                out.append((len(words), len(words) - len(kept), _digest(kept)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]], ["_id", "n_words", "n_removed", "kept_sha256"])

    kind = found.schema["_id"].dataType.simpleString()
    return found.select("_id", "text", "covered", "starts").mapInArrow(cut, f"_id {kind}, n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256 (of the words that
    stay, joined by a space). A word goes if a window of ``window`` consecutive words
    covers it whose words also start earlier: in a document of smaller id, or earlier in
    its own.

    Null texts have no words; texts shorter than a window keep all. Of rows that share an
    id neither comes first, so they only lose what they repeat of smaller ids or of
    themselves. Rows without an id come after all others and none of them before another.
    An empty table gives no rows. Long texts are parsed in overlapping pieces, which
    changes no result. Other columns, of any name, are ignored."""
    spark = docs.sparkSession
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")  # each step is written, so that its shuffles may go
    try:
        base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        base = base.withColumn("_twin", F.xxhash64("_text"))
        seen = materialise(symbols(base, window), "recompression-symbols")
        label = ["name", "check", "size"]
        shared = seen.groupBy(*label).agg(F.min("_id").alias("least"), F.sum("n").alias("times")).where("times > 1").drop("times")
        marks = seen.join(shared, label).groupBy("_id").agg(F.sort_array(F.collect_set(F.struct("name", _later("_id", "least").alias("earlier")))).alias("m"))
        marks = materialise(marks.select(F.col("_id").alias("_k"), F.col("m.name").alias("names"), F.col("m.earlier").alias("earlier")), "recompression-marks")
        discard(seen)
        parts = materialise(windows(base.join(marks, F.col("_id").eqNullSafe(F.col("_k")), "left"), window), "recompression-windows")
        discard(marks)
        left = parts.where("at IS NOT NULL").select("_id", "_twin", "at", "one", "two")
        twice = left.groupBy("one", "two").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.max(F.col("_id").isNull()).alias("none"))
        twice = twice.where("least < most OR (none AND least IS NOT NULL)").select("one", "two", "least")
        again = left.join(twice, ["one", "two"]).where(_later("_id", "least"))
        again = materialise(again.groupBy(F.col("_id").alias("_k"), F.col("_twin").alias("_t")).agg(F.collect_set("at").alias("starts")), "recompression-repeats")
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)
    on = F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_twin") == F.col("_t"))
    texts = parts.where("at IS NULL")
    kept = texts.where("text IS NULL").select("_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    cut = _cut(texts.where("text IS NOT NULL").select("_id", "_twin", "text", "covered").join(again, on, "left"), window)
    return kept.unionByName(cut).withColumnRenamed("_id", id_col)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
placed AS (
  SELECT doc_id, p, sha256(array_to_string(words[p:p + 19], ' ')) AS seq
  FROM w, unnest(range(1, len(words) - 18)) AS u(p)),
again AS (
  SELECT doc_id, p FROM placed
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS p FROM again, range(20) AS r(i)),
each_word AS (SELECT doc_id, words[p] AS word, p FROM w, unnest(range(1, len(words) + 1)) AS u(p)),
stay AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept
  FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN stay USING (doc_id)
"""
