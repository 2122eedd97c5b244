"""Timelines that know what they rate, and searches over them.

A timeline is a row of slices with at most one node (version, time) a version in each, in
order of time within every version. Beside the slices stands the place of every node as an
array, so that the matrix of links between slices is one count over the graph's edges, and
the rating a few steps over that matrix. Changes are logged, so that a candidate is tried
and taken back in time that follows the nodes it moves.

Searches run a collection a task; a collection is one piece in its versions, and its size
does not grow with the table.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .partition import PRESETS

Node = tuple[int, int]


class Links:
    """The similarity graph by number of node, nodes in order: their neighbours, as sets and
    as what takes their entries from a list, the edges as two arrays, and the nodes one
    position before and behind (-1: none). Loops are left out; neighbours are mutual."""

    def __init__(self, near: dict[Node, set]):
        self.given = near
        self.nodes = sorted(near)
        self.number = {n: i for i, n in enumerate(self.nodes)}
        self.version, self.time = [v for v, _ in self.nodes], [t for _, t in self.nodes]
        self.near = [{self.number[o] for o in near[n] if o != n and o in self.number} for n in self.nodes]
        self.entries = [itemgetter(*o) if len(o) > 1 else (lambda spots, o=tuple(o): [spots[j] for j in o]) for o in self.near]
        ends = [(i, j) for i, o in enumerate(self.near) for j in o if i < j]
        self.a, self.b = np.array(ends, np.int64).reshape(-1, 2).T
        self.beside = {d: [self.number.get((v, t + d), -1) for v, t in self.nodes] for d in (-1, 1)}


class Timeline:
    """Of nodes of the graph. They go by their number inside, and by (version, time) in
    ``add``, ``remove``, ``move``, ``fits``, ``slices`` and ``at``."""

    def __init__(self, near: dict[Node, set] | Links, preset: str = "msa"):
        self.links = near if isinstance(near, Links) else Links(near)
        self.near, self.powers = self.links.given, PRESETS[preset]
        self.order: list[int] = []  # slices by their place
        self.place: dict[int, int] = {}
        self.members: dict[int, dict[int, int]] = {}  # slice: version: node
        self.spots = [-1] * len(self.links.nodes)  # node: slice
        self.placed: dict[int, list[int]] = {}  # version: nodes with a slice, in order
        self.log: list[tuple] = []
        self._next = 0

    @staticmethod
    def of(slices: list[list[Node]], near: dict | Links, **options) -> "Timeline":
        """From slices; nodes that would break the order are left out."""
        t = Timeline(near, **options)
        for s in slices:
            x = t.insert(len(t.order))
            for node in sorted(s):
                t.add(node, x)
        return t

    @property
    def at(self) -> dict[Node, int]:
        """Nodes with a slice."""
        return {n: x for n, x in zip(self.links.nodes, self.spots) if x >= 0}

    def slices(self) -> list[list[Node]]:
        return [[self.links.nodes[i] for i in sorted(self.members[x].values())] for x in self.order]

    def copy(self) -> "Timeline":
        return Timeline.of(self.slices(), self.links)._with(self.powers)

    def _with(self, powers) -> "Timeline":
        self.powers = powers
        return self

    # Changes, each with its opposite in the log.

    def between(self, i: float, v: int | None = None) -> tuple[int, int]:
        """The places of the version's nodes before and after."""
        placed = self.placed.get(self.links.version[i] if v is None else v)
        if not placed:
            return -1, len(self.order)
        n = bisect_left(placed, i)
        after = n + (n < len(placed) and placed[n] == i)
        low = self.place[self.spots[placed[n - 1]]] if n else -1
        return low, self.place[self.spots[placed[after]]] if after < len(placed) else len(self.order)

    def may(self, i: int, x: int) -> bool:
        """Whether the node's version has none in the slice, and its others are in order."""
        if self.spots[i] >= 0 or self.links.version[i] in self.members[x]:
            return False
        low, high = self.between(i)
        return low < self.place[x] < high

    def put(self, i: int, x: int) -> bool:
        if not self.may(i, x):
            return False
        self._put(i, x)
        self.log.append((self._take, i))
        return True

    def take(self, i: int) -> None:
        self.log.append((self._put, i, self._take(i)))

    def shift(self, i: int, x: int) -> bool:
        """To another slice, if order allows."""
        was = self._take(i)
        if self.may(i, x):
            self._put(i, x)
            self.log += [(self._put, i, was), (self._take, i)]
            return True
        self._put(i, was)
        return False

    def fits(self, node: Node, x: int) -> bool:
        if node in self.links.number:
            return self.may(self.links.number[node], x)
        low, high = self.between(bisect_left(self.links.nodes, node) - 0.5, node[0])
        return node[0] not in self.members[x] and low < self.place[x] < high

    def add(self, node: Node, x: int) -> bool:
        return self.put(self.links.number[node], x)

    def remove(self, node: Node) -> None:
        self.take(self.links.number[node])

    def move(self, node: Node, x: int) -> bool:
        return self.shift(self.links.number[node], x)

    def insert(self, i: int) -> int:
        """A new empty slice at a place."""
        x = self._next
        self._next += 1
        self._open(i, x)
        self.log.append((self._close, x))
        return x

    def drop(self, x: int) -> None:
        for i in list(self.members[x].values()):
            self.take(i)
        self.log.append((self._open, self._close(x), x))

    def back_to(self, mark: int) -> None:
        """Undo all since the log had ``mark`` entries."""
        while len(self.log) > mark:
            undo, *args = self.log.pop()
            undo(*args)

    def _put(self, i: int, x: int) -> None:
        v = self.links.version[i]
        self.spots[i] = x
        self.members[x][v] = i
        insort(self.placed.setdefault(v, []), i)

    def _take(self, i: int) -> int:
        v, x = self.links.version[i], self.spots[i]
        self.spots[i] = -1
        del self.members[x][v]
        self.placed[v].remove(i)
        return x

    def _open(self, i: int, x: int) -> None:
        self.order.insert(i, x)
        self.members[x] = {}
        self._replace(i)

    def _close(self, x: int) -> int:
        """Take an empty slice away."""
        i = self.place.pop(x)
        del self.order[i], self.members[x]
        self._replace(i)
        return i

    def _replace(self, i: int) -> None:
        """Places from ``i`` on."""
        self.place.update(zip(self.order[i:], range(i, len(self.order))))

    # The links of slices and nodes.

    def places(self) -> np.ndarray:
        """The place of every node by number, -1 without a slice."""
        where = np.full(self._next + 1, -1)  # the last for no slice
        where[self.order] = np.arange(len(self.order))
        return where[np.array(self.spots, np.int64)]

    def matrix(self) -> np.ndarray:
        """Links between slices by place, those inside a slice counted once."""
        k, places = len(self.order), self.places()
        a, b = places[self.links.a], places[self.links.b]
        both = (a >= 0) & (b >= 0)
        n = np.bincount((a * k + b)[both], minlength=k * k).reshape(k, k)
        inside = n.diagonal().copy()
        n = n + n.T
        np.fill_diagonal(n, inside)
        return n

    def node_links(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of every node, by number, to every slice, by place; and the nodes' places."""
        k, places, a, b = len(self.order), self.places(), self.links.a, self.links.b
        out = np.zeros(len(places) * k, np.int64)
        for one, other in ((a, b), (b, a)):
            to = places[other]
            out += np.bincount((one * k + to)[to >= 0], minlength=len(out))
        return out.reshape(len(places), k), places

    # The rating.

    def factors(self) -> dict[str, float]:
        """The factors of ``partition.sequence_rating``; nan where undefined."""
        k, m = len(self.order), self.matrix()
        flat = m.ravel()
        at = np.flatnonzero(flat)
        n, step = flat[at], np.diff(at)
        bins, links, own = len(at), int(n.sum()), int(m.trace())
        beside = step == 1  # rows follow one another
        mins, maxs = int(np.minimum(n[:-1], n[1:])[beside].sum()), int(np.maximum(n[:-1], n[1:])[beside].sum())
        row = at // max(k, 1)
        counts = np.bincount(step[row[1:] == row[:-1]])
        gaps = {int(g): int(counts[g]) for g in np.flatnonzero(counts)}
        held = np.zeros((k, k + 2), bool)  # an empty column on either side
        held[:, 1:-1] = m > 0
        lone = int((held[:-1, 1:-1] & held[1:, 2:] & ~held[:-1, :-2] & ~held[:-1, 2:]).sum())
        sizes = [len(self.members[x]) for x in self.order if self.members[x]]
        mean = sum(sizes) / len(sizes) if sizes else 0.0
        spread = math.sqrt(sum((s - mean) ** 2 for s in sizes) / (len(sizes) - 1)) if len(sizes) > 1 else 0.0
        total = sum(gaps.values())
        shares = {g: c / total for g, c in gaps.items()}
        nan = math.nan
        return {
            "node_count": float(sum(sizes)), "compactness": mean / (1 + spread),
            "self_connectedness": own / k if bins else nan, "connectedness": links / bins if bins else nan, "non_empty": bins / (k * k) if bins else nan,
            "gap_entropy": 1 - sum(p * math.log(p) for _, p in sorted(shares.items())) if total else nan,
            "gap_size": sum(g * p for g, p in sorted(shares.items())) / max(gaps) if total else nan,
            "adjacents_min": 1 + mins / links if links else nan, "adjacents_max": 1 + maxs / links if links else nan,
            "diagonals": 1 + lone / (bins + 1),
        }

    def rating(self) -> float:
        """The product of the preset's factors to their powers. A factor that is undefined
        (no gaps where every slice links with one, no links) counts as 1, where
        ``partition.sequence_rating`` gives 0: a perfect timeline is a diagonal."""
        found = self.factors()
        if not found["node_count"]:
            return 0.0
        return math.prod(found[name] ** power for name, power in self.powers.items() if not math.isnan(found[name]))


# Candidates: functions that change a timeline, each in one way.


def links_to(t: Timeline, i: int) -> dict[int, int]:
    """Links of a node by slice."""
    out: dict[int, int] = {}
    for x in t.links.entries[i](t.spots):
        if x >= 0:
            out[x] = out.get(x, 0) + 1
    return out


def add_missing(t: Timeline, unlinked: bool = False) -> None:
    """Nodes without a slice go where most of their links are, if order allows; with
    ``unlinked`` those between two neighbours of their version too, into the middle."""
    place = t.place
    for i in [i for i, x in enumerate(t.spots) if x < 0]:
        links = links_to(t, i)
        if not links and not unlinked:
            continue
        low, high = t.between(i)  # no slice between these has a node of the version
        if high - low == 1:
            continue
        linked = [(n, -place[x], x) for x, n in links.items() if low < place[x] < high]
        if linked:
            t.put(i, max(linked)[2])
        elif unlinked and high - low - 1 < len(t.order):
            t.put(i, t.order[low + 1 + (high - low - 1) // 2])


def slide(t: Timeline) -> None:
    """Nodes go to a slice in reach where they have more links."""
    links, places = t.node_links()
    if not links.size:
        return
    asks = (places >= 0) & (links.max(1) > links[np.arange(len(places)), places])
    order = np.argsort(places, kind="stable")
    asks, place = asks.tolist(), t.place
    for i in order[places[order] >= 0].tolist():
        if not asks[i]:  # none but the neighbours of a node that moved have new links
            continue
        links, v = links_to(t, i), t.links.version[i]
        here = links.get(t.spots[i], 0)
        better = sorted((-n, place[x], x) for x, n in links.items() if n > here and v not in t.members[x])
        if not better:
            continue
        low, high = t.between(i)
        for _, at, x in better:
            if low < at < high:
                t.shift(i, x)
                for o in t.links.near[i]:
                    asks[o] = True
                break


def merge_neighbours(t: Timeline) -> None:
    """Slices of different versions become one with the next."""
    i = 0
    while i + 1 < len(t.order):
        a, b = t.order[i], t.order[i + 1]
        if not t.members[a].keys().isdisjoint(t.members[b]):
            i += 1
            continue
        nodes = list(t.members[b].values())
        t.drop(b)
        for node in nodes:
            t.put(node, a)


def drop_small(t: Timeline, factor: float) -> None:
    """Slices smaller than the largest over ``factor`` go, and those of a single node."""
    least = max(2, max((len(m) for m in t.members.values()), default=0) / factor)
    for x in [x for x in t.order if len(t.members[x]) < least]:
        t.drop(x)


def insert_group(t: Timeline, group: list[int]) -> None:
    """A slice of these nodes where most of them fit: behind the median place of what comes
    before them in their versions."""
    ends = sorted(t.between(i)[0] + 1 for i in group)
    x = t.insert(ends[len(ends) // 2])
    for i in sorted(group):
        t.put(i, x)
    if len(t.members[x]) < 2:
        t.drop(x)


def grouping(t: Timeline, far: int = 100):
    """Groups of a free node and its free neighbours in other versions at similar times, the
    largest first, as new slices, a group a step."""
    spots, near, version, time = t.spots, t.links.near, t.links.version, t.links.time
    left = {i for i, x in enumerate(spots) if x < 0}
    free = {i: near[i] & left for i in sorted(left)}
    for i in sorted(free, key=lambda i: -len(free[i])):  # ties to the smaller node
        if not free[i]:
            return
        if spots[i] >= 0:
            continue
        group, at = {version[i]: i}, time[i]
        for off, o in sorted([(abs(time[o] - at), o) for o in free[i] if spots[o] < 0]):
            if off <= far:
                group.setdefault(version[o], o)
        if len(group) > 1:
            insert_group(t, list(group.values()))
            yield


def besides(t: Timeline, factor: float = 3.0):
    """New slices of the free and linked nodes one position before or behind a slice, a
    slice a step."""
    spots, near = t.spots, t.links.near
    least = max((len(m) for m in t.members.values()), default=0) / factor
    for x in sorted(t.order, key=lambda x: (-len(t.members[x]), t.place[x])):
        for step in (-1, 1):
            beside = t.links.beside[step]
            group = [n for i in t.members[x].values() if (n := beside[i]) >= 0 and spots[n] < 0]
            if len(group) < 2 or len(group) < least:
                continue
            own = set(group)
            group = [i for i in group if not near[i].isdisjoint(own)]
            if len(group) > 1 and len(group) >= least:
                new = t.insert(t.place[x] + (step > 0))
                for i in group:
                    t.put(i, new)
                if len(t.members[new]) < 2:
                    t.drop(new)
                yield


def _first(steps, most: int | None) -> None:
    for done, _ in enumerate(steps, 1):
        if done == most:
            break


def add_groups(t: Timeline, most: int | None = None, far: int = 100) -> None:
    """The first ``most`` of ``grouping``, or all."""
    _first(grouping(t, far), most)


def add_beside(t: Timeline, most: int | None = None, factor: float = 3.0) -> None:
    """The first ``most`` of ``besides``, or all."""
    _first(besides(t, factor), most)


def blurs(t: Timeline) -> list[Node]:
    """Nodes with a link into the next slice."""
    links, places = t.node_links()
    i = np.flatnonzero((places >= 0) & (places < len(t.order) - 1))
    i = i[links[i, places[i] + 1] > 0]
    return [t.links.nodes[j] for j in i[np.argsort(places[i], kind="stable")]]


def minor(t: Timeline) -> list[Node]:
    """Nodes with links of the smallest tenth of the groups of links between slices."""
    m = np.triu(t.matrix(), 1)
    i, j = np.nonzero(m)
    order = np.lexsort((j, i, m[i, j]))[: len(i) // 10]
    links, out = t.node_links()[0], {}
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        out.update((n, None) for n in sorted(t.members[t.order[a]].values()) if links[n, b])
    return [t.links.nodes[n] for n in out]


def _own_and_most(t: Timeline) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of nodes with a slice: their numbers, links to it, and most links to any."""
    links, places = t.node_links()
    i = np.flatnonzero(places >= 0)
    return i, links[i, places[i]], links[i].max(1, initial=0)


def strays(t: Timeline) -> list[Node]:
    """Nodes with more links to another slice than to their own."""
    i, own, most = _own_and_most(t)
    return [t.links.nodes[j] for j in i[most > own]]


def unlinked(t: Timeline) -> list[Node]:
    """Nodes without a link inside their slice."""
    i, own, _ = _own_and_most(t)
    return [t.links.nodes[j] for j in i[own == 0]]


def outside(t: Timeline) -> list[Node]:
    """Nodes outside their slice's largest component."""
    out = []
    for x in t.order:
        left, parts = set(t.members[x].values()), []
        while left:
            part, front = set(), {min(left)}
            while front:
                part |= front
                left -= front
                front = set().union(*[t.links.near[i] & left for i in front])
            parts.append(part)
        parts.sort(key=lambda p: (-len(p), min(p)))
        out += [t.links.nodes[i] for p in parts[1:] for i in sorted(p)]
    return out


def _without(nodes: list[Node]):
    def change(t: Timeline) -> None:
        for n in nodes:
            i = t.links.number[n]
            if t.spots[i] >= 0:
                t.take(i)

    return change


#: Where a candidate stops that adds slices step by step, beside one that adds all.
STOPS = (2, 5, 10)


def _whole(t: Timeline) -> list:
    return [merge_neighbours, slide, add_missing, lambda t: add_missing(t, True), lambda t: drop_small(t, 3.0)]


def building(t: Timeline) -> list:
    """Candidates that add, join and move."""
    some = lambda add: [add, *[lambda t, m=m: add(t, m) for m in STOPS]]
    return [*_whole(t), *some(add_groups), *some(add_beside)]


def clearing(t: Timeline) -> list:
    """Candidates that take nodes away, together and in chunks."""
    out = []
    for find, sizes in ((blurs, (10, 50)), (minor, (1, 5)), (strays, (10,)), (unlinked, (1 << 30,)), (outside, (1 << 30,))):
        nodes = find(t)
        out += [_without(nodes[i : i + size]) for size in sizes for i in range(0, len(nodes), size)]
    return out


def tried(t: Timeline, change, factor: float) -> float:
    """The rating after a change and the removal of small slices, which stay in the log."""
    change(t)
    drop_small(t, factor)
    return t.rating()


def _settled(t: Timeline, factor: float, mark: int) -> float:
    """The rating without small slices, after which all since the mark is undone."""
    drop_small(t, factor)
    value = t.rating()
    t.back_to(mark)
    return value


def ratings(t: Timeline, kinds, factor: float) -> list[float]:
    """What ``tried`` gives for each candidate, each undone. Those of ``building`` that add
    step by step go the same way, so they go it once and are rated where they stop."""
    mark, out = len(t.log), []
    for change in _whole(t) if kinds is building else kinds(t):
        change(t)
        out.append(_settled(t, factor, mark))
    for steps in (grouping, besides) if kinds is building else ():
        found = {}
        for done, _ in enumerate(steps(t), 1):
            if done in STOPS:
                found[done] = _settled(t, factor, len(t.log))
        every = _settled(t, factor, mark)
        out += [every, *[found.get(m, every) for m in STOPS]]
    return out


def beam(t: Timeline, *, width: int = 1, factor: float = 2.0) -> Timeline:
    """The best timeline found from ``t``: each round tries what builds, and where nothing
    helps what clears, and keeps the ``width`` best. It ends when none rates higher, which
    it must, as ratings only rise."""
    held = [(t.rating(), t)]
    while True:
        for kinds in (building, clearing):
            found = []
            for rank, (_, base) in enumerate(held):
                found += [(-value, rank, number) for number, value in enumerate(ratings(base, kinds, factor))]
            found.sort()
            new = []
            for value, rank, number in found[:width]:
                if -value > held[-1][0] + 1e-12 or (len(held) < width and -value > 0):
                    copy = held[rank][1].copy()
                    new.append((tried(copy, kinds(copy)[number], factor), copy))
            best = sorted(held + new, key=lambda h: -h[0])[:width]
            if best[0][0] > held[0][0] + 1e-12:
                held = best
                break
        else:
            return held[0][1]


def grow(near: dict, *, preset: str = "msa", factor: float = 3.0, patience: int = 3) -> Timeline:
    """Groups of free nodes and the slices beside them, then what improves them, round by
    round over what is still free; the best one, when ``patience`` rounds brought none."""
    t = Timeline(near, preset)
    best, value, idle = t.copy(), 0.0, 0
    while idle < patience:
        for change in (add_groups, add_beside, merge_neighbours, add_missing, slide, lambda t: _without(strays(t))(t)):
            change(t)
        drop_small(t, factor)
        t.log.clear()
        new = t.rating()
        idle += 1
        if new > value + 1e-12:
            best, value, idle = t.copy(), new, 0
    return best


def neighbours_of(pdf: pd.DataFrame) -> dict:
    near: dict = {}
    for a, b, c, d in zip(pdf.v1.tolist(), pdf.t1.tolist(), pdf.v2.tolist(), pdf.t2.tolist()):
        near.setdefault((a, b), set()).add((c, d))
        near.setdefault((c, d), set()).add((a, b))
    return near


def timelines(edges: DataFrame, key: str, *, method: str = "beam", preset: str = "msa", width: int = 1) -> DataFrame:
    """key, slice, version, time, rating of each collection's timeline: grown, or grown and
    then searched by beam. Edges join (v1, t1) and (v2, t2), one row a pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = grow(neighbours_of(pdf), preset=preset)
        if method == "beam":
            t = beam(t, width=width)
        value = t.rating()
        return pd.DataFrame([(pdf[key].iloc[0], i, v, x, value) for i, s in enumerate(t.slices()) for v, x in s], columns=[key, "slice", "version", "time", "rating"])

    # small pieces, long searches: spread by number of cores, not by bytes
    spark = edges.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return edges.repartition(tasks, key).groupBy(key).applyInPandas(run, f"{key} long, slice long, version long, time long, rating double")
