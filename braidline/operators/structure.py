"""Sections and labels from slices and their connection matrix."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_groups(cells: list[tuple[int, int, float]], *, threshold: float = 0.3, n: int = 1, least_distance: int = 0) -> list[list[list[int]]]:
    """Section types, each a list of runs of slices that correspond to one another.

    Masked cells that are among the largest of both their row and column link slices;
    components of links that move on by one, slice for slice, make runs. Runs of single
    slices are not joined. No links make no sections."""
    top = max((v for i, j, v in cells if i != j), default=0)
    kept = [(i, j, v) for i, j, v in cells if i != j and abs(i - j) > least_distance and v >= threshold * top and v > 0]

    def best(side):
        rows: dict = {}
        for c in kept:
            rows.setdefault(c[side], []).append(c)
        return {c for r in rows.values() for c in r if sum(x[2] > c[2] for x in r) < n}

    links = best(0) & best(1)
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, j, _ in links:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    comps: dict = {}
    for x in up:
        comps.setdefault(find(x), []).append(x)
    ordered = [sorted(c) for _, c in sorted(comps.items())]
    chains: list[list[list[int]]] = []
    for c in ordered:
        last = chains[-1][-1] if chains else None
        if last and len(last) == len(c) and all(b == a + 1 for a, b in zip(last, c)):
            chains[-1].append(c)
        else:
            chains.append([c])
    return [[list(run) for run in zip(*chain)] for chain in chains]


def sections(matrix: DataFrame, keys: list[str], **options) -> DataFrame:
    """keys, slice, section, occurrence, position. Connection matrices are small (slices,
    not nodes), so each collection's is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = section_groups(list(zip(pdf.i.tolist(), pdf.j.tolist(), pdf.n.tolist())), **options)
        key = [pdf[k].iloc[0] for k in keys]
        rows = [(*key, s, t, o, p) for t, runs in enumerate(found) for o, r in enumerate(runs) for p, s in enumerate(r)]
        return pd.DataFrame(rows, columns=[*keys, "slice", "section", "occurrence", "position"])

    schema = ", ".join(f"{k} long" for k in keys) + ", slice long, section long, occurrence long, position long"
    return matrix.groupBy(*keys).applyInPandas(run, schema)


def section_labels(part: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, slice, label: a slice's mode, or, in a section, the mode of all slices at the
    same position of its occurrences; ties to the value first seen last."""
    pooled = part.join(found.select(*keys, "slice", "section", "position"), [*keys, "slice"], "left")
    where = [*keys, "section", "position", F.when(F.col("section").isNull(), F.col("slice")).alias("alone")]
    n = pooled.groupBy(*where, value).agg(F.count("*").alias("n"), F.min("version").alias("seen"))
    modes = n.groupBy(*keys, "section", "position", "alone").agg(F.max_by(value, F.struct("n", "seen", value)).alias("label"))
    spots = pooled.select(*keys, "slice", "section", "position", F.when(F.col("section").isNull(), F.col("slice")).alias("alone")).distinct()
    same = [spots[k] == modes[k] for k in keys] + [spots[c].eqNullSafe(modes[c]) for c in ("section", "position", "alone")]
    joined = spots.join(modes, same)
    return joined.select(*[spots[k] for k in keys], spots["slice"], modes["label"])


def annotate(seq: DataFrame, part: DataFrame, labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sequences whose nodes in a slice take the slice's label."""
    placed = part.select(*keys, "version", "time", "slice").join(labels, [*keys, "slice"])
    out = seq.join(placed.select(*keys, "version", "time", "label"), [*keys, "version", "time"], "left")
    return out.withColumn("label", F.coalesce("label", value))


def pair_merges(symbols: list) -> list[tuple]:
    """A hierarchy of a type sequence: the commonest pair becomes a new type, again and
    again while a pair recurs. Each is (new, left, right, times)."""
    seq, out, new = list(symbols), [], max([-1, *symbols]) + 1
    while True:
        counts: dict = {}
        last = None
        for p in zip(seq, seq[1:]):
            if p != last or p[0] != p[1]:
                counts[p] = counts.get(p, 0) + 1
                last = p
            else:
                last = None
        best = max(counts, key=lambda p: (counts[p], -p[0], -p[1]), default=None)
        if best is None or counts[best] < 2:
            return out
        merged, i = [], 0
        while i < len(seq):
            if i + 1 < len(seq) and (seq[i], seq[i + 1]) == best:
                merged.append(new)
                i += 2
            else:
                merged.append(seq[i])
                i += 1
        out.append((new, *best, counts[best]))
        seq, new = merged, new + 1


def boundaries(part: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Slices behind which more than ``least`` symbols were inserted over all versions."""
    w = Window.partitionBy(*keys, "version").orderBy("slice")
    d = part.withColumns({"dt": F.lead("time").over(w) - F.col("time"), "ds": F.lead("slice").over(w) - F.col("slice")})
    return d.groupBy(*keys, "slice").agg(F.sum(F.greatest(F.col("dt") - F.col("ds"), F.lit(0))).alias("inserts")).where(F.col("inserts") > least)
