"""N-gram Jaccard join by T-occurrence search, with components of the links.

A document's set holds hashes (64 bits) of its distinct five-word shingles. Equal sets
form a class, of which only the smallest id goes on. Two sets with a Jaccard similarity
of ``num``/``den`` or more share a token among the first n - ceil(n * num / den) + 1 of
each, in any one order of all tokens; tokens that recur come last in that order, the
commoner the later, so that documents which merely share a passage do not meet. What
recurs is counted exactly, over all different sets: stretches of the table send their
tokens as keys of some 34 bits and more (it grows with the table) in blobs, one a range
of keys, and each range tells each stretch which of its keys recur. A stretch then posts
its documents' first keys; those that do not recur meet nothing and are not posted, so a
document of whose shingles a fifth are its own posts none. Keys that clash only add
candidates, never a link. Documents that share such a
token are in one candidate cluster (components over one edge a document and token, to
the token's smallest document); most are in none.

In a cluster, an inverted index finds partners: a query's T-occurrence search merges
its short lists with a heap, keeps documents that occur often enough, and probes the
long lists for those by binary search (DivideSkip). Only components are wanted, so a
document needs no query while it is in the cluster's largest component and every
document outside has been a query: a group of thousands of near copies costs a few
queries, not its square, and no link between different components is lost.

A cluster above ``shard_docs`` documents is searched in shards. A document of its
largest component is then a query to every shard, and so is, after that, each document
still outside: any link left to find has such an end.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, materialise
from .tokens import chunks

WORDS = 5
MU = 0.0085  # DivideSkip's weight of a probe against a merge step
KEY_BITS = 18  # bits of a key beyond those of the number of documents
SLOT_BITS = 20
HEAVY = 24  # counts from which a token's documents are dealt out by salts
_C1, _C2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_P, _Q = 0x100000001B3, 0x9E3779B97F4A7C15


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_C1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_C2)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]):
    """Distinct shingle hashes of all texts, sorted within each, and how many each has.
    Words are runs without ASCII white space, A-Z lower; fewer than five make one
    shingle; null counts as empty."""
    import numpy as np

    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    counts = np.zeros(len(raw), "i8")
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", "u1")
    begins = np.cumsum([1] + [len(x) + 1 for x in raw])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not len(starts):
        return np.zeros(0, "u8"), counts
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype("u8") + np.uint64(1)
    low[space] = 0
    sizes = ends - starts
    first = np.zeros(len(data), "i8")
    first[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(first)
    place[: starts[0]] = 0
    place[space] = 0
    power = np.multiply.accumulate(np.full(int(sizes.max()) + 1, _P, "u8"))
    words = _mix(np.add.reduceat(low * power[place], starts) + sizes.astype("u8") * np.uint64(_Q))
    doc = np.searchsorted(begins, starts, "right") - 1
    n_words = np.bincount(doc, minlength=len(raw))
    keys, owner = [], []
    if len(words) >= WORDS:
        h = words[: len(words) - WORDS + 1].copy()
        for j in range(1, WORDS):
            h = h * np.uint64(_Q) + words[j : len(words) - WORDS + 1 + j]
        ok = doc[: len(h)] == doc[WORDS - 1 :]
        keys.append(_mix(h[ok]))
        owner.append(doc[: len(h)][ok])
    few = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(few):
        at = np.searchsorted(doc, few)
        h = np.full(len(few), 0, "u8")
        for j in range(WORDS - 1):
            more = j < n_words[few]
            h[more] = h[more] * np.uint64(_Q) + words[at[more] + j]
        keys.append(_mix(h + n_words[few].astype("u8")))
        owner.append(few)
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    counts += np.bincount(owner[new], minlength=len(raw))
    return keys[new], counts


def _read(batches):
    """Ids, texts in bounded pieces."""
    for b in batches:
        texts = b.column(1).to_pylist()
        for i, j in chunks(texts):
            yield b.column(0).slice(i, j - i), texts[i:j]


def packed(x) -> bytes:
    """Whole numbers as bytes, by place, as few places as the largest needs; high bytes
    that are alike then lie side by side."""
    import numpy as np

    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + x.view("u1").reshape(len(x), 8)[:, :width].T.tobytes()


def unpacked(b: bytes):
    import numpy as np

    width = b[0]
    raw = np.frombuffer(b, "u1", offset=1).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), "u1")
    out[:, :width] = raw.T
    return out.view("<i8").ravel()


def _signatures(batches):
    """A row a document: id, set size, 128-bit set hash."""
    import numpy as np

    for ids, texts in _read(batches):
        keys, counts = shingle_sets(texts)
        begin = np.cumsum(counts) - counts
        sums = np.zeros((2, len(counts)), "u8")
        some = counts > 0
        if some.any():
            sums[0, some] = np.add.reduceat(_mix(keys + np.uint64(_C1)), begin[some])
            sums[1, some] = np.add.reduceat(_mix(keys ^ np.uint64(_C2)), begin[some])
        yield pa.record_batch([ids, pa.array(counts), pa.array(sums[0].view("i8")), pa.array(sums[1].view("i8"))], ["id", "n", "h1", "h2"])


#: Rows of stretches: ``counts`` are how often a key is in the stretch, or its weight.
_STRETCH = "stretch long, part long, keys binary, owners binary, counts binary, ids array<long>, sizes array<long>"
_TOKENS, _MANY = 2_000_000, (1 << 16) - 1


def _stretch_rows(ids, keys, sizes, key_bits: int, range_bits: int):
    """A stretch's rows: for each range its keys, in order and as differences, each once,
    with the document it is of (by place) or _MANY; and, as part -1, the documents, and the
    keys that several hold with their holders, which no range need see."""
    import uuid

    import numpy as np

    keys = (keys.view("u8") >> np.uint64(64 - key_bits)).astype("i8")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    once, begin, times = np.unique(keys, return_index=True, return_counts=True)
    many = times > 1
    held = np.repeat(many, times)
    of = np.where(many, _MANY, owner[begin]) if len(once) else owner
    cuts = np.searchsorted(once, np.arange((1 << range_bits) + 1) << (key_bits - range_bits))
    name = uuid.uuid4().int >> 65
    rows = [(name, -1, packed(np.diff(keys[held], prepend=0)), packed(owner[held]), None, list(ids), sizes.tolist())]
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(cuts[part], cuts[part + 1])
        rows.append((name, part, packed(np.diff(once[s], prepend=part << (key_bits - range_bits))), packed(of[s]), packed(times[s]), None, None))
    names = [x.split()[0] for x in _STRETCH.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)


def _stretches(batches, key_bits: int, range_bits: int):
    """All documents' keys, dealt out by ranges, a stretch of the table at a time."""
    import numpy as np

    ids, keys, sizes = [], [], []
    size = rows = 0
    for some, texts in _read(batches):
        for at in range(0, len(texts), _MANY):
            k, n = shingle_sets(texts[at : at + _MANY])
            if ids and (size + len(k) > _TOKENS or rows + len(n) > _MANY):
                yield _stretch_rows(np.concatenate(ids).tolist(), np.concatenate(keys), np.concatenate(sizes), key_bits, range_bits)
                ids, keys, sizes = [], [], []
                size = rows = 0
            ids.append(np.asarray(some.slice(at, len(n))))
            keys.append(k)
            sizes.append(n)
            size, rows = size + len(k), rows + len(n)
    if ids:
        yield _stretch_rows(np.concatenate(ids).tolist(), np.concatenate(keys), np.concatenate(sizes), key_bits, range_bits)


def _recurring(key_bits: int, range_bits: int):
    """Of a range, to each stretch those of its keys that recur in all, with a weight: 1, or
    their count from HEAVY on. Of keys that several of a stretch hold, only heavy ones."""

    def run(key, rows):
        import numpy as np

        part = key[0].as_py()
        base = part << (key_bits - range_bits)
        keys = [np.cumsum(unpacked(x)) + base for x in rows.column("keys").to_pylist()]
        owners = [unpacked(x) for x in rows.column("owners").to_pylist()]
        ends = np.cumsum([len(x) for x in keys])
        _, at, = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(at.max() + 1, "i8")
        np.add.at(n, at, np.concatenate([unpacked(x) for x in rows.column("counts").to_pylist()]))
        out = []
        for name, k, o, i, j in zip(rows.column("stretch").to_pylist(), keys, owners, ends - [len(x) for x in keys], ends):
            times = n[at[i:j]]
            told = np.where(o == _MANY, times >= HEAVY, times > 1)
            if told.any():
                out.append((name, part, packed(np.diff(k[told], prepend=base)), packed(o[told]), packed(np.where(times[told] < HEAVY, 1, times[told]))))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        none = pa.nulls(len(out), pa.list_(pa.int64()))
        return pa.table([*(pa.array(c, k) for c, k in zip(columns, kinds)), none, none], [x.split()[0] for x in _STRETCH.split(", ")])

    return run


def _posted(key_bits: int, range_bits: int, num: int, den: int, salts: int):
    """Of a stretch, each document's keys among the first that partners must share, but for
    those that do not recur, which come before all others and meet nothing."""

    def run(t):
        import numpy as np

        keys, owners, weights = [], [], []
        own = t.filter(pa.array([p < 0 for p in t.column("part").to_pylist()])).to_pylist()[0]
        for r in t.select(["part", "keys", "owners", "counts"]).to_pylist():
            if r["part"] >= 0:
                keys.append(np.cumsum(unpacked(r["keys"])) + (r["part"] << (key_bits - range_bits)))
                owners.append(unpacked(r["owners"]))
                weights.append(unpacked(r["counts"]))
        none = np.zeros(0, "i8")
        keys, owners, weights = (np.concatenate([none, *x]) for x in (keys, owners, weights))
        held = owners == _MANY
        heavy, times = keys[held], weights[held]
        order = np.argsort(heavy)
        heavy, times = heavy[order], times[order]
        shared, holders = np.cumsum(unpacked(own["keys"])), unpacked(own["owners"])
        their = np.ones(len(shared), "i8")
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, shared), len(heavy) - 1)
            their = np.where(heavy[at] == shared, times[at], their)
        keys, owners, weights = (np.concatenate(x) for x in ((keys[~held], shared), (owners[~held], holders), (weights[~held], their)))
        order = np.lexsort((keys, weights, owners))
        keys, owners, weights = keys[order], owners[order], weights[order]
        sizes = np.array(own["sizes"], "i8")
        recur = np.bincount(owners, minlength=len(sizes))
        rank = np.arange(len(keys)) - np.repeat(np.cumsum(recur) - recur, recur)
        keep = rank < (recur - required(sizes, num, den) + 1)[owners]
        node = np.array(own["ids"], "i8")[owners[keep]]
        salt = np.where(weights[keep] >= HEAVY, (node.view("u8") * np.uint64(_Q) >> np.uint64(58)).astype("i8") % salts + 1, 0)
        return pa.table({"token": keys[keep], "node": node, "salt": salt})

    return run


def required(n, num: int, den: int):
    """The least overlap of a set of n elements with any partner."""
    return -(-n * num // den)


class Searcher:
    """T-occurrence search over sets (sorted arrays); a set's number is its position.
    The inverted lists lie behind one another in one array, by token."""

    def __init__(self, sets, num: int, den: int):
        import numpy as np

        self.sizes, self.num, self.den = [len(s) for s in sets], num, den
        every = np.concatenate(sets) if sets else np.zeros(0, "i8")
        order = np.argsort(every, kind="stable")
        self.owners = np.repeat(np.arange(len(sets), dtype="i4"), self.sizes)[order]
        self.tokens, begins = np.unique(every[order], return_index=True)
        self.begins = np.append(begins, len(every))

    def search(self, query, skip=lambda i: False) -> list[int]:
        """Positions whose similarity with ``query`` suffices; ``skip`` leaves some out."""
        import numpy as np

        n, num, den = len(query), self.num, self.den
        least = max(1, required(n, num, den))
        if not len(self.tokens) or not n:
            return []
        at = np.searchsorted(self.tokens, query)
        at = at[(at < len(self.tokens)) & (self.tokens[np.minimum(at, len(self.tokens) - 1)] == query)]
        if len(at) < least:
            return []
        lengths = self.begins[at + 1] - self.begins[at]
        order = np.argsort(lengths, kind="stable")
        lists = [self.owners[i : i + k] for i, k in zip(self.begins[at[order]].tolist(), lengths[order].tolist())]
        n_long = min(int(least / (MU * int(lengths.max()).bit_length() + 1)), least - 1)
        short, long = [x.tolist() for x in lists[: len(lists) - n_long]], [x.tolist() for x in lists[len(lists) - n_long :]]
        found, last, times = [], -1, 0
        for i in heapq.merge(*short):
            if i == last:
                times += 1
                continue
            if times >= least - n_long:
                self._probe(last, times, n, long, found, skip)
            last, times = i, 1
        if times >= least - n_long:
            self._probe(last, times, n, long, found, skip)
        return found

    def _probe(self, i, times, n, long, found, skip):
        if skip(i):
            return
        m, num, den = self.sizes[i], self.num, self.den
        need = -(-num * (n + m) // (den + num))
        for at, x in enumerate(long):
            if times >= need or times + len(long) - at < need:
                break
            j = bisect_left(x, i)
            times += j < len(x) and x[j] == i
        if times >= need:
            found.append(i)


class Sets:
    """Union-find by position, which knows its largest set."""

    def __init__(self, n: int):
        self.up, self.size, self.top = list(range(n)), [1] * n, 0

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.up[j] = i
            self.size[i] += self.size[j]
        if self.size[i] > self.size[self.find(self.top)]:
            self.top = i


def components(nodes: list[int], sets, num: int, den: int) -> list[int]:
    """The smallest node of each position's component."""
    groups, search = Sets(len(sets)), Searcher(sets, num, den)
    by_node: dict[int, int] = {}
    for i, k in enumerate(nodes):
        groups.join(i, by_node.setdefault(k, i))
    waiting = list(range(len(sets)))
    while True:
        outside = [i for i in waiting if groups.find(i) != groups.find(groups.top)]
        if not outside:
            break
        queried = set()
        for i in outside:
            if groups.find(i) == groups.find(groups.top):
                continue
            own = groups.find(i)
            for j in search.search(sets[i], lambda j: groups.find(j) == own):
                groups.join(i, j)
                own = groups.find(i)
            queried.add(i)
        waiting = [i for i in waiting if i not in queried]
    least: dict[int, int] = {}
    for i, k in enumerate(nodes):
        r = groups.find(i)
        least[r] = min(least.get(r, k), k)
    return [least[groups.find(i)] for i in range(len(sets))]


def _sets_of(texts):
    import numpy as np

    keys, counts = zip(*(shingle_sets(texts[i:j]) for i, j in chunks(texts)))
    return np.split(np.concatenate(keys).view("i8"), np.cumsum(np.concatenate(counts))[:-1])


def slot_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(1 << SLOT_BITS)).cast("int")


def slots_of(ids: DataFrame, column: str) -> DataFrame:
    """The slots of ids: at most 2 ** SLOT_BITS rows, so small enough to send around. A
    row whose slot is not among them surely has none of the ids."""
    return ids.select(slot_of(column).alias("slot")).distinct()


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, shard_docs: int = 2_000
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Null and empty texts have no shingles and are linked with nothing; a null id has a
    null component. Rows that share an id are one document. Empty tables give no rows;
    other columns are ignored."""
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = materialise(picked.mapInArrow(_signatures, "id long, n long, h1 long, h2 long"), "jaccard-sets")
    rows = signed.count()
    range_bits = min(16, max(6, (rows // 1000).bit_length()))
    key_bits = min(56, max(34, rows.bit_length() + KEY_BITS))
    classes = signed.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    classes = materialise(classes, "jaccard-classes")

    # texts stay where they are unless their id's slot is one of a copy's
    reps = classes.select(F.col("rep").alias("id")).distinct()
    copies = slots_of(signed.where(F.col("id").isNotNull() & (F.col("n") > 0)).join(reps, "id", "left_anti"), "id")
    slotted = picked.where(F.col("id").isNotNull()).withColumn("slot", slot_of("id"))
    alone = slotted.join(F.broadcast(copies), "slot", "left_anti").select("id", "text")
    checked = slotted.join(F.broadcast(copies), "slot", "left_semi").select("id", "text").join(reps.hint("merge"), "id", "left_semi")
    stretches = alone.unionByName(checked).mapInArrow(lambda b: _stretches(b, key_bits, range_bits), _STRETCH)
    stretches = materialise(stretches, "jaccard-stretches")
    told = stretches.where("part >= 0").groupBy("part").applyInArrow(_recurring(key_bits, range_bits), _STRETCH)
    told = told.unionByName(stretches.where("part < 0")).groupBy("stretch")
    posted = told.applyInArrow(_posted(key_bits, range_bits, num, den, 64), "token long, node long, salt long")
    posted = posted.withColumn("first", F.min("node").over(Window.partitionBy("token", "salt")))
    met = materialise(posted.where((F.col("node") != F.col("first")) | (F.col("salt") > 0)).distinct(), "jaccard-met")
    discard(stretches)
    # a frequent token's documents meet in salted groups, and their firsts once more
    firsts = met.where("salt > 0").groupBy("token", "first").agg(F.lit(1))
    firsts = firsts.withColumn("least", F.min("first").over(Window.partitionBy("token"))).select(F.col("first").alias("src"), F.col("least").alias("dst"))
    edges = met.select(F.col("node").alias("src"), F.col("first").alias("dst")).unionByName(firsts).where("src <> dst").distinct()
    clusters = materialise(connected_components(edges), "jaccard-clusters")
    sizes = clusters.groupBy("component").agg(F.count("*").alias("members"))
    shards = F.ceil(F.col("members") / shard_docs).cast("int")
    placed = clusters.join(sizes, "component").withColumn("shards", shards)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    placed = materialise(placed.select("node", "component", "shards", "shard"), "jaccard-placed")
    near = slotted.join(F.broadcast(slots_of(placed, "node")), "slot", "left_semi").select(F.col("id").alias("node"), "text")
    members = materialise(near.join(placed.hint("merge"), "node").select("node", "component", "shards", "shard", "text"), "jaccard-members")

    def local(group):
        nodes = group.column("node").to_pylist()
        least = components(nodes, _sets_of(group.column("text").to_pylist()), num, den)
        cluster, shards = group.column("component").slice(0, 1), group.column("shards").slice(0, 1)
        n = len(nodes)
        return pa.table({"node": nodes, "least": pa.array(least, pa.int64()), "component": pa.array(cluster.to_pylist() * n), "shards": pa.array(shards.to_pylist() * n, pa.int32())})

    found = members.groupBy("component", "shard").applyInArrow(local, "node long, least long, component long, shards int")
    found = materialise(found, "jaccard-found")
    final = found.where("shards = 1").select("node", "least")
    large = found.where("shards > 1")
    if large.limit(1).count():
        links = large.select(F.col("node").alias("src"), F.col("least").alias("dst"))
        last = materialise(_across_shards(members.where("shards > 1"), large, links, num, den), "jaccard-large")
        final = final.unionByName(last)
    named = classes.join(final.groupBy("node").agg(F.min("least").alias("least")).withColumnRenamed("node", "rep"), "rep", "left")
    named = materialise(named.select("n", "h1", "h2", F.coalesce("least", "rep").alias("component_id")), "jaccard-named")
    out = signed.join(named, ["n", "h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _across_shards(members, large, links, num, den):
    """node, least of clusters in several shards, given each shard's own links."""

    def asked(queries):
        """Links found by sending ``queries`` (node) to every shard of their cluster."""
        sent = members.join(queries, "node").withColumn("shard", F.explode(F.expr("sequence(0, shards - 1)"))).withColumn("asks", F.lit(True))
        both = members.withColumn("asks", F.lit(False)).unionByName(sent)

        def search(group):
            texts, nodes, asks = (group.column(c).to_pylist() for c in ("text", "node", "asks"))
            sets = _sets_of(texts)
            filed = [i for i, a in enumerate(asks) if not a]
            index = Searcher([sets[i] for i in filed], num, den)
            pairs = [(nodes[i], nodes[filed[j]]) for i, a in enumerate(asks) if a for j in index.search(sets[i])]
            return pa.table({"src": pa.array([p[0] for p in pairs], pa.int64()), "dst": pa.array([p[1] for p in pairs], pa.int64())})

        return both.groupBy("component", "shard").applyInArrow(search, "src long, dst long")

    def joined(links):
        """node, least of the links, and its cluster."""
        return materialise(connected_components(links).join(large.select(F.col("node"), "component").withColumnRenamed("component", "cluster"), "node").distinct(), "jaccard-joined")

    def main(state):
        n = state.groupBy("cluster", "component").agg(F.count("*").alias("size"))
        return n.groupBy("cluster").agg(F.max_by("component", F.struct("size", -F.col("component"))).alias("component"))

    state = joined(links)
    pivots = main(state).select(F.col("component").alias("node"))
    links = materialise(links.unionByName(asked(pivots)), "jaccard-links")
    state = joined(links)
    outside = state.join(main(state), ["cluster", "component"], "left_anti").select("node")
    links = links.unionByName(asked(outside))
    return connected_components(links).select("node", F.col("component").alias("least"))
