"""Growing and improving timelines of one collection, a collection a task.

A node is (version, time); ``near`` maps each node to its neighbours in the similarity
graph; slices are lists of nodes in order. No function changes what it is given.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame

from .graph_local import bridge_pairs
from .search import rating, valid

# Admission to a group: each gives the members after a node asked to join, or None.


def different_versions(node, members, near):
    return None if any(m[0] == node[0] for m in members) else [*members, node]


def apart(least: int = 8):
    """Nodes of one version may share a group from so many positions on."""
    return lambda node, members, near: None if any(m[0] == node[0] and abs(m[1] - node[1]) < least for m in members) else [*members, node]


def similar_time(most: int = 100):
    """Different versions, and no two times further apart."""
    return lambda node, members, near: None if any(m[0] == node[0] or abs(m[1] - node[1]) > most for m in members) else [*members, node]


def better_linked(node, members, near):
    """Different versions; a node takes the place of its version's member, unless that is
    the center, where this adds links inside the group."""
    if members[0][0] == node[0]:
        return None
    same = [m for m in members if m[0] == node[0]]
    if not same:
        return [*members, node]
    changed = [node if m == same[0] else m for m in members]
    return changed if links_inside(changed, near) > links_inside(members, near) else None


CONDITIONS = {"versions": different_versions, "apart": apart(), "similar_time": similar_time(), "linked": better_linked}


def links_inside(nodes, near) -> int:
    have = set(nodes)
    return sum(len(near.get(x, set()) & have) for x in have) // 2


def ranked_groups(near: dict, admit, *, most: int | None = None) -> list[tuple[int, list]]:
    """(links inside, members) of each node with the neighbours admitted in order, one for
    each set of members, the most linked first, ties to the smaller center."""
    seen, out = set(), []
    for center in sorted(near):
        members = [center]
        for x in sorted(near[center]):
            members = admit(x, members, near) or members
        if frozenset(members) not in seen:
            seen.add(frozenset(members))
            out.append((links_inside(members, near), members))
    out.sort(key=lambda g: -g[0])
    return out[:most]


def without_members(groups, gone, near) -> list[tuple[int, list]]:
    """Groups shrunk by the nodes ``gone`` and rated anew; those of one node end."""
    gone, out = set(gone), []
    for _, members in groups:
        left = [m for m in members if m not in gone]
        if len(left) > 1:
            out.append((links_inside(left, near), left))
    return sorted(out, key=lambda g: -g[0])


def unique_members(groups) -> list:
    return sorted({m for _, members in groups for m in members})


def successive_groups(near: dict, admit, count: int) -> list[list]:
    """The best group, taken out of the graph with what it isolates, then the next."""
    left, out = {x: set(n) for x, n in near.items()}, []
    while left and len(out) < count:
        found = ranked_groups(left, admit, most=1)
        if not found or found[0][0] == 0:
            break
        gone = set(found[0][1])
        out.append(found[0][1])
        left = {x: n - gone for x, n in left.items() if x not in gone and n - gone}
    return out


def followers(before, after) -> list:
    """Nodes one position behind a node of the same version."""
    have = set(before)
    return [x for x in after if (x[0], x[1] - 1) in have]


def disjunct_partition(near: dict, admit, *, least: int = 1, count: int | None = None, most: int | None = None) -> list[list]:
    """The most linked group, then whichever keeps most members, while more than ``least``."""
    groups, out = ranked_groups(near, admit, most=most), []
    chosen = groups[0][1] if groups else None
    while chosen:
        out.append(chosen)
        if count and len(out) >= count:
            break
        groups = without_members(groups, chosen, near)
        chosen = max((g[1] for g in groups), key=len, default=None)
        if chosen and len(chosen) <= least:
            break
    return out


def successive_partition(near: dict, admit, *, count: int | None = None, most: int | None = None) -> list[list]:
    """A sequence grown to either side by the group with most successors of its last slice
    or predecessors of its first, over a third of the group; the seed moves on to the next
    best group until it finds a partner."""
    groups = ranked_groups(near, admit, most=most)
    for start in range(len(groups)):
        out, left = [groups[start][1]], groups[start + 1 :]
        left = without_members(left, out[0], near)
        while left and not (count and len(out) >= count):
            after = max(left, key=lambda g: len(followers(out[-1], g[1])))[1]
            before = max(left, key=lambda g: len(followers(g[1], out[0])))[1]
            n_after, n_before = len(followers(out[-1], after)), len(followers(before, out[0]))
            chosen, n = (after, n_after) if n_after >= n_before else (before, n_before)
            if n <= len(chosen) / 3:
                break
            out = [*out, chosen] if n_after >= n_before else [chosen, *out]
            left = without_members(left, chosen, near)
        if len(out) > 1:
            return out
    return [groups[0][1]] if groups else []


def neighbouring_slices(slices, near: dict, nodes, *, factor: float = 3.0) -> list[list]:
    """Slices moved on and back by one position, again and again, as far as their nodes
    are free and linked, and more than the largest slice's size over ``factor``."""
    free = set(nodes) - {x for s in slices for x in s}
    least, last, out = max(map(len, slices), default=0) / factor, slices, []
    while last:
        moved = [[(v, t + d) for v, t in s if (v, t + d) in free] for d in (-1, 1) for s in last]
        linked = [[x for x in s if near.get(x, set()) & set(s)] for s in moved]
        last = []
        for s in linked:
            s = [x for x in s if x in free]
            if len(s) > 1 and len(s) > least:
                last.append(s)
                free -= set(s)
        out += last
    return out


def completed(values: list) -> list[float]:
    """Missing numbers on the line between known ones; leading ones 0, trailing ones one
    more each."""
    known = [i for i, x in enumerate(values) if x is not None]
    if not known:
        return [0.0] * len(values)
    out = []
    for i, x in enumerate(values):
        if x is not None or i < known[0]:
            out.append(float(x or 0))
        elif i > known[-1]:
            out.append(out[-1] + 1)
        else:
            a, b = max(k for k in known if k < i), min(k for k in known if k > i)
            out.append(values[a] + (values[b] - values[a]) * (i - a) / (b - a))
    return out


def place(node, slices, near, *, insert: bool = False, ignore_links: bool = False):
    """Slices with ``node`` where it keeps its version's order and has most neighbours, of
    those nearest to its time as interpolated; else, with ``insert``, in a slice of its
    own beside its version's next or previous node; None if there is no place."""
    version, time = node
    times = [min((t for v, t in s if v == version), default=None) for s in slices]
    fits = [
        not any(t is not None and t > time for t in times[: i + 1]) and not any(t is not None and t < time for t in times[i:]) and times[i] != time
        for i in range(len(slices))
    ]
    links = [(1 if ignore_links else len(near.get(node, set()) & set(s))) if ok else 0 for ok, s in zip(fits, slices)]
    if links and max(links) > 0:
        full = completed(times)
        at = min((i for i, n in enumerate(links) if n == max(links)), key=lambda i: abs(full[i] - time))
        return [[*s, node] if i == at else s for i, s in enumerate(slices)]
    if insert:
        later = next((i for i, t in enumerate(times) if t is not None and t > time), None)
        earlier = next((i for i in reversed(range(len(times))) if times[i] is not None and times[i] < time), None)
        at = later if later is not None else earlier + 1 if earlier is not None else None
        if at is not None:
            return [*slices[:at], [node], *slices[at:]]
    return None


def chunks_of(items: list, parts: int = 50, least: int = 20, most: int = 50) -> list[list]:
    size = min(most, max(round(len(items) / parts), least))
    return [items[i : i + size] for i in range(0, len(items), size)]


def with_missing(slices, near, nodes, **options) -> list[list[list]]:
    """A candidate for each chunk of the nodes not yet placed, put where each fits best."""
    missing = sorted(set(nodes) - {x for s in slices for x in s})
    out = []
    for chunk in chunks_of(missing):
        found = slices
        for x in chunk:
            found = place(x, found, near, **options) or found
        if found is not slices:
            out.append(found)
    return out


def without_chunks(slices, gone: list) -> list[list[list]]:
    out = []
    for chunk in chunks_of(sorted(gone)):
        some = set(chunk)
        out.append([[x for x in s if x not in some] for s in slices])
    return out


def linked_counts(node, slices, near) -> list[int]:
    mine = near.get(node, set())
    return [len(mine & set(s)) for s in slices]


def strays(slices, near) -> list:
    """Nodes better linked to another slice than to their own."""
    return [x for i, s in enumerate(slices) for x in s if linked_counts(x, slices, near)[i] < max(linked_counts(x, slices, near))]


def unlinked(slices, near) -> list:
    """Nodes without a link inside their slice."""
    return [x for s in slices for x in s if not near.get(x, set()) & set(s)]


def inside(s, near) -> dict:
    have = set(s)
    return {x: near.get(x, set()) & have for x in s}


def minor(slices, near) -> list:
    """Nodes outside the largest component of their slice."""
    out = []
    for s in slices:
        graph, left, parts = inside(s, near), set(s), []
        while left:
            part, queue = set(), [min(left)]
            while queue:
                x = queue.pop()
                if x not in part:
                    part.add(x)
                    queue += graph[x]
            parts.append(part)
            left -= part
        parts.sort(key=lambda p: (-len(p), min(p)))
        out += [x for p in parts[1:] for x in p]
    return out


def uncycled(slices, near) -> list:
    """Nodes in no cycle of their slice's graph."""
    out = []
    for s in slices:
        graph = inside(s, near)
        bridges = set(bridge_pairs(graph))
        out += [x for x in s if all(tuple(sorted((x, y))) in bridges for y in graph[x])]
    return out


def slides(slices, near, *, unlinked_too: bool = False) -> list[list[list]]:
    """For each version the longest set of its nodes that are best linked to a slice the
    same distance away, and may move there: what they meet is empty or moves as well."""
    wish = defaultdict(lambda: defaultdict(dict))
    where = {x: i for i, s in enumerate(slices) for x in s}
    for x, i in where.items():
        counts = linked_counts(x, slices, near)
        top = max(counts)
        if top >= (0 if unlinked_too else 1):
            for j, n in enumerate(counts):
                if n == top and j != i:
                    wish[x[0]][j - i][i] = x
    out = []
    for version in sorted(wish):
        taken = {where[x] for x in where if x[0] == version}
        best: dict = {}
        for delta in sorted(wish[version]):
            movable = dict(wish[version][delta])
            while True:
                stuck = [i for i in movable if i + delta in taken and i + delta not in movable]
                if not stuck:
                    break
                for i in stuck:
                    del movable[i]
            if len(movable) > len(best):
                best, step = movable, delta
        if best:
            gone = set(best.values())
            out.append([[x for x in s if x not in gone] + [x for i, x in best.items() if i + step == j] for j, s in enumerate(slices)])
    return out


def swaps(slices, near) -> list[list[list]]:
    """A slice's only node with links to a later slice goes there, in place of its
    version's node if that has fewer; the one replaced is free again."""
    out = []
    for i, s in enumerate(slices):
        for j in range(i + 1, len(slices)):
            drawn = [x for x in s if near.get(x, set()) & set(slices[j])]
            if not drawn:
                continue
            if len(drawn) == 1:
                x = drawn[0]
                rival = next((y for y in slices[j] if y[0] == x[0]), None)
                if rival is None or len(near[x] & set(slices[j])) > len(near.get(rival, set()) & set(slices[j])):
                    there = [y for y in slices[j] if y != rival] + [x]
                    out.append([[y for y in t if y != x] if k == i else there if k == j else t for k, t in enumerate(slices)])
            break
    return out


def merges(slices) -> list[list]:
    """Slices joined to the one before while the two share no version."""
    out: list[list] = []
    for s in slices:
        if out and not {v for v, _ in out[-1]} & {v for v, _ in s}:
            out[-1] = [*out[-1], *s]
        else:
            out.append(list(s))
    return out


IMPROVEMENTS = {
    "merge": lambda s, near, nodes: [merges(s)],
    "swap": lambda s, near, nodes: swaps(s, near),
    "slide": lambda s, near, nodes: slides(s, near),
    "missing": lambda s, near, nodes: with_missing(s, near, nodes),
    "missing_any": lambda s, near, nodes: with_missing(s, near, nodes, ignore_links=True),
    "missing_insert": lambda s, near, nodes: with_missing(s, near, nodes, insert=True),
    "blurs": lambda s, near, nodes: without_chunks(s, unlinked(s, near)),
    "minor": lambda s, near, nodes: without_chunks(s, minor(s, near)),
    "cycles": lambda s, near, nodes: without_chunks(s, uncycled(s, near)),
    "affinity": lambda s, near, nodes: without_chunks(s, strays(s, near)),
    "small": lambda s, near, nodes: [[x for x in s if len(x) > 2]],
}


def improved(slices, near, nodes, kinds=tuple(IMPROVEMENTS)) -> tuple[list[list], float]:
    """The best of all candidates, again and again until none rates higher."""
    held = valid(slices)
    value = rating(held, near)
    while True:
        found = [valid(c) for k in kinds for c in IMPROVEMENTS[k](held, near, nodes)]
        best = max(found, key=lambda s: rating(s, near), default=held)
        if rating(best, near) <= value + 1e-12:
            return held, value
        held, value = best, rating(best, near)


def in_order(slices) -> list[list]:
    """Slices ordered by the median of their times."""
    return sorted(slices, key=lambda s: (sorted(t for _, t in s)[len(s) // 2], sorted(s)))


def grown(near: dict, nodes, *, method: str = "successive", condition: str = "similar_time", factor: float = 3.0) -> tuple[list[list], float]:
    """A timeline from a first partition and the slices beside it, improved; then what the
    same finds among the nodes left, while that improves it."""
    admit, make = CONDITIONS[condition], {"successive": successive_partition, "disjunct": disjunct_partition}[method]
    held, value = [], 0.0
    while True:
        placed = {x for s in held for x in s}
        left = {x: n - placed for x, n in near.items() if x not in placed}
        start = make({x: n for x, n in left.items() if n}, admit)
        more = start + neighbouring_slices(start, left, set(nodes) - placed, factor=factor)
        if not more:
            return held, value
        found, new = improved(in_order(held + more), near, nodes)
        if new <= value + 1e-12:
            return held, value
        held, value = found, new


def neighbours_of(pdf: pd.DataFrame) -> dict:
    near: dict = {}
    for a, b, c, d in zip(pdf.v1, pdf.t1, pdf.v2, pdf.t2):
        near.setdefault((int(a), int(b)), set()).add((int(c), int(d)))
        near.setdefault((int(c), int(d)), set()).add((int(a), int(b)))
    return near


def grown_timelines(edges: DataFrame, key: str, **options) -> DataFrame:
    """key, slice, version, time, rating of the timeline grown for each collection; edges
    join (v1, t1) and (v2, t2)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = neighbours_of(pdf)
        slices, value = grown(near, near, **options)
        return pd.DataFrame([(pdf[key].iloc[0], i, v, t, value) for i, s in enumerate(slices) for v, t in s], columns=[key, "slice", "version", "time", "rating"])

    return edges.groupBy(key).applyInPandas(run, f"{key} long, slice long, version long, time long, rating double")


def node_groups(edges: DataFrame, key: str, *, condition: str = "versions", count: int = 10) -> DataFrame:
    """key, rank, version, time: the groups taken one after another from each graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = successive_groups(neighbours_of(pdf), CONDITIONS[condition], count)
        return pd.DataFrame([(pdf[key].iloc[0], i, v, t) for i, g in enumerate(found) for v, t in g], columns=[key, "rank", "version", "time"])

    return edges.groupBy(key).applyInPandas(run, f"{key} long, rank long, version long, time long")
