"""Timelines by search: moves, validity, rating and a beam, one collection a task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def valid(slices: list[list], least: int = 2) -> list[list]:
    """Slices with one node a version (the earliest), each node once, times in order
    within a version, and at least ``least`` nodes. Nodes are (version, time)."""
    seen, latest, out = set(), {}, []
    for s in slices:
        kept: dict = {}
        for v, t in sorted(s):
            if v not in kept and (v, t) not in seen and t > latest.get(v, -1):
                kept[v] = t
        if len(kept) >= least:
            for v, t in kept.items():
                seen.add((v, t))
                latest[v] = t
            out.append(sorted(kept.items()))
    return out


def rating(slices: list[list], near: dict, known: dict | None = None) -> float:
    """Placed nodes times compactness (mean size over 1 + deviation) times the share of
    links that stay inside a slice. ``known`` keeps the links of slices met before."""
    import statistics

    if not slices:
        return 0.0
    known = {} if known is None else known
    sizes, inside, links = [len(s) for s in slices], 0, 0
    for s in slices:
        key = tuple(s)
        if key not in known:
            own = set(s)
            known[key] = sum(len(near.get(x, own - own) & own) for x in s), sum(len(near.get(x, ())) for x in s)
        inside, links = inside + known[key][0], links + known[key][1]
    spread = statistics.stdev(sizes) if len(sizes) > 1 else 0.0
    return sum(sizes) * statistics.mean(sizes) / (1 + spread) * (inside + 1) / (links + 1)


def moves(slices: list[list], near: dict) -> list[list[list]]:
    """Candidates: neighbouring slices merged, a missing node put where most of its
    neighbours are, a slice's direct successors inserted behind it, a small one dropped."""
    out = []
    for i in range(len(slices) - 1):
        if not {v for v, _ in slices[i]} & {v for v, _ in slices[i + 1]}:
            out.append(slices[:i] + [slices[i] + slices[i + 1]] + slices[i + 2 :])
    placed = {x: i for i, s in enumerate(slices) for x in s}
    groups: dict = {}
    for x in sorted(set(near) - set(placed)):
        at: dict = {}
        for y in near[x]:
            if y in placed:
                at[placed[y]] = at.get(placed[y], 0) + 1
        if at:
            groups.setdefault(max(at, key=lambda i: (at[i], -i)), []).append(x)
    if groups:
        out.append([s + groups.get(i, []) for i, s in enumerate(slices)])
    for i, s in enumerate(slices):
        after = sorted({(v, t + 1) for v, t in s} & (set(near) - set(placed)))
        if len(after) > 1:
            out.append(slices[: i + 1] + [after] + slices[i + 1 :])
        if len(s) < 3:
            out.append(slices[:i] + slices[i + 1 :])
    return out


def beam(start: list[list], near: dict, *, width: int = 1) -> tuple[list[list], float]:
    """The best slices found; stops when no candidate rates higher than the beam. Ratings
    only rise, so it does stop."""
    first, known = valid(start), {}
    held = [(rating(first, near, known), first)]
    while True:
        found = [(rating(s, near, known), s) for _, h in held for s in map(valid, moves(h, near))]
        best = sorted(held + found, key=lambda x: -x[0])[:width]
        if best[0][0] <= held[0][0] + 1e-12:
            return held[0][1], held[0][0]
        held = best


def seed(near: dict) -> list[list]:
    """Groups of a node and its neighbours in other versions, the largest first, that
    follow one another in time."""
    left, out = set(near), []
    while left:
        x = max(sorted(left), key=lambda x: len(near[x] & left))
        group = ({x} | near[x]) & left
        if len(group) < 2:
            break
        out.append(sorted(group))
        left -= group
    return sorted(out, key=lambda g: (sorted(t for _, t in g)[len(g) // 2], g))


def timelines(edges: DataFrame, key: str, **options) -> DataFrame:
    """key, slice, version, time, rating of the best timeline of each collection; edges
    join (v1, t1) and (v2, t2)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b, c, d in zip(pdf.v1, pdf.t1, pdf.v2, pdf.t2):
            near.setdefault((a, b), set()).add((c, d))
            near.setdefault((c, d), set()).add((a, b))
        slices, value = beam(seed(near), near, **options)
        return pd.DataFrame([(pdf[key].iloc[0], i, v, t, value) for i, s in enumerate(slices) for v, t in s], columns=[key, "slice", "version", "time", "rating"])

    return edges.groupBy(key).applyInPandas(run, f"{key} long, slice long, version long, time long, rating double")
