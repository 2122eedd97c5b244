"""Best-fit packing of token sequences by swap-based local search.

Documents are cut into pieces of at most ``capacity`` tokens (only those that are
longer). Pieces are dealt by a hash into groups of about ``group_items``, so a task's
memory is bounded whatever the table's size, and each group is packed alone: bins are
filled in order of arrival, and local search does the rest over the underfull ones. A
step takes the emptiest bin and, for its documents, looks for a fuller bin to move to, or
to trade places with one smaller document (one for one), one for two of its own or two for
one of its own (two for one), of all that fit the one that leaves least room. Each step puts tokens into a fuller bin, so the sum of
squared fills grows, until bins empty or no step is left.

A group ends with its room gathered in its emptiest bin. These bins of all groups meet in
rounds, ``MEET`` groups at a time, and are searched again, so that the whole table has one
rest and not one a group.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import chunks, encoder

CAPACITY = 4096
MEET = 64


def arrival_fill(lengths, capacity: int) -> list[list[int]]:
    """Bins of item numbers in their order; what does not fit the last bin begins one."""
    bins: list[list[int]] = []
    room = 0
    for i, n in enumerate(lengths):
        if n > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= n
    return bins


class Search:
    """Local search over bins; ``steps`` counts what it did."""

    def __init__(self, bins: list[list[int]], lengths, capacity: int):
        import numpy as np

        self.bins, self.lengths, self.capacity = [list(b) for b in bins], np.asarray(lengths, "i8"), capacity
        self.fill = np.array([self.lengths[b].sum() for b in bins], "i8")
        self.place = np.zeros(len(self.lengths), "i8")
        for b, items in enumerate(bins):
            self.place[items] = b
        self.steps: Counter = Counter()

    def run(self) -> list[list[int]]:
        """Until no step is left, or no fewer bins can hold the items and the emptiest bin
        has no step left."""
        import numpy as np

        n, capacity, fill = self.lengths, self.capacity, self.fill
        floor = max(-(-int(n.sum()) // capacity), int((2 * n > capacity).sum()))
        live, stuck, moved = int((fill > 0).sum()), np.zeros(len(fill), bool), False
        while True:
            under = np.flatnonzero((fill > 0) & (fill < capacity))
            free = under[~stuck[under]]
            least = under[fill[under].argmin()] if len(under) else -1
            if not len(under) or live <= floor and stuck[least]:
                break
            if not len(free):
                if not moved:
                    break
                stuck[:], moved = False, False
                continue
            source = int(free[fill[free].argmin()])
            if self._step(source):
                moved = True
                live -= fill[source] == 0
            else:
                stuck[source] = True
        return [b for b in self.bins if b]

    def _trade(self, kind: str, source: int, target: int, give: list[int], take: list[int]) -> bool:
        for i, a, b in [*((i, source, target) for i in give), *((k, target, source) for k in take)]:
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.place[i] = b
            self.fill[a] -= self.lengths[i]
            self.fill[b] += self.lengths[i]
        self.steps[kind] += 1
        return True

    def _step(self, source: int) -> bool:
        """A move or trade into a fuller bin: the first kind that is possible, of it the
        largest document's, of these the one that leaves least room."""
        import numpy as np

        lengths, none = self.lengths, self.capacity + 1
        room = self.capacity - self.fill
        fuller = (self.fill >= self.fill[source]) & (room > 0)
        fuller[source] = False
        if not fuller.any():
            return False
        pool = np.flatnonzero(fuller[self.place])
        pool_length, pool_room = lengths[pool], room[self.place[pool]]
        mine = {int(lengths[i]): [i] for i in self.bins[source]}
        for n in sorted(mine, reverse=True):
            left = np.where(fuller & (room >= n), room - n, none)
            b = int(left.argmin())
            if left[b] < none:
                return self._trade("move", source, b, mine[n], [])
        pairs = {int(lengths[i] + lengths[k]): [i, k] for x, i in enumerate(self.bins[source]) for k in self.bins[source][:x]}
        for kind, given in (("one for one", mine), ("two for one", pairs)):
            for n in sorted(given, reverse=True):
                gain = n - pool_length
                left = np.where((gain > 0) & (gain <= pool_room), pool_room - gain, none)
                j = int(left.argmin())
                if left[j] < none:
                    return self._trade(kind, source, int(self.place[pool[j]]), given[n], [int(pool[j])])
        return self._one_for_two(source, pool[np.argsort(self.place[pool], kind="stable")], room, mine)

    def _one_for_two(self, source: int, pool, room, mine) -> bool:
        """A document against two of a bin: pairs of neighbours, of next ones, and so on
        among documents in order of their bins."""
        import numpy as np

        place, length, sizes = self.place[pool], self.lengths[pool], sorted(mine, reverse=True)
        for apart in range(1, len(pool)):
            same = np.flatnonzero(place[apart:] == place[:-apart])
            if not len(same):
                return False
            both, rooms = length[same] + length[same + apart], room[place[same]]
            for n in sizes:
                gain = n - both
                left = np.where((gain > 0) & (gain <= rooms), rooms - gain, self.capacity + 1)
                j = int(left.argmin())
                if left[j] <= self.capacity:
                    i = same[j]
                    return self._trade("two for one", source, int(place[i]), mine[n], [int(pool[i]), int(pool[i + apart])])
        return False


def token_pieces(docs: DataFrame, path: str, *, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def run(batches):
        import numpy as np

        code = encoder(path)
        end = np.array([end_id], code.dtype).tobytes()
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in chunks(texts):
                keys = b.column(0).slice(i, j - i).to_pylist()
                out = [
                    (k, p, p * capacity, len(cut), zlib.crc32(cut.tobytes()))
                    for k, ids in zip(keys, (np.frombuffer(x + end, code.dtype).astype("<u4") for x in code.encode(texts[i:j])))
                    for p in range(-(-len(ids) // capacity))
                    for cut in (ids[capacity * p : capacity * (p + 1)],)
                ]
                yield pa.record_batch(
                    [pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = picked.mapInArrow(run, "doc_id long, piece long, start long, length long, ids_crc32 long")
    return found.withColumn("piece", F.col("piece").cast("int"))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_items: int = 4096) -> DataFrame:
    """``pieces`` with sequence_id and offset; needs columns doc_id, piece, length.
    Lengths are 1 to ``capacity``; an empty table gives no rows."""
    n = pieces.count()
    groups = max(1, -(-n // group_items))
    # ids that repeat, or null ones, would meet in one group by their hash alone
    spread = F.pmod(F.xxhash64("doc_id", "piece", "length", F.monotonically_increasing_id()), F.lit(groups))
    keyed = pieces.withColumns({"_group": spread.cast("long"), "_bin": F.lit(None).cast("long")})
    keyed = materialise(keyed, "pack-groups")
    given = [f.name for f in pieces.schema]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    schema += ", _group long, sequence_id long, offset long, _rest boolean"
    done, round_ = None, 0
    while True:
        found = materialise(keyed.groupBy("_group").applyInArrow(_placing(given, capacity, round_), schema), "pack-round")
        if groups == 1:
            break
        full = found.where("NOT _rest")
        done = full if done is None else done.unionByName(full)
        groups, round_ = -(-groups // MEET), round_ + 1
        keyed = found.where("_rest").select(*given, F.floor(F.col("_group") / MEET).alias("_group"), F.col("sequence_id").alias("_bin"))
    found = found if done is None else done.unionByName(found)
    return found.drop("_group", "_rest")


def _placing(given: list[str], capacity: int, round_: int):
    """Packs a group: from its order, or from the bins that its rows bring along. The
    emptiest bin is the rest."""

    def place(key, group):
        lengths, brought = group.column("length").to_pylist(), group.column("_bin").to_pylist()
        if round_:
            bins: dict = {}
            for i, b in enumerate(brought):
                bins.setdefault(b, []).append(i)
            start = list(bins.values())
        else:
            start = arrival_fill(lengths, capacity)
        bins = Search(start, lengths, capacity).run()
        fills = [sum(lengths[i] for i in b) for b in bins]
        emptiest = min(range(len(bins)), key=fills.__getitem__, default=0)
        sequence, offset, rest = [0] * len(lengths), [0] * len(lengths), [False] * len(lengths)
        base = round_ << 56 | key[0].as_py() << 24
        for s, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i], rest[i] = base + s, at, s == emptiest
                at += lengths[i]
        out = group.select([*given, "_group"])
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("_rest", rest, pa.bool_())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return place


def pack_documents(docs: DataFrame, path: str, *, end_id: int = 1, capacity: int = CAPACITY, id_col="doc_id", text_col="text"):
    """Tokenise, cut and pack. Null texts count as empty and give the end id alone;
    repeated rows each give their own pieces; an empty table gives no rows."""
    pieces = materialise(token_pieces(docs, path, end_id=end_id, capacity=capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, capacity=capacity)
