"""Sections of ordered slices: from links with the joining rules, level by level from a
matrix, from the labels alone, and from the labels' alignment with themselves.

What is sequential works on the slices of one key (a collection's timeline, not its
nodes); labels, alignments and types are DataFrame plans.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Sections = list[list[list[int]]]


def components_of(links, slices) -> list[list[int]]:
    """Sorted components of the slices, by their first; a slice without links is its own."""
    near: dict = {s: set() for s in slices}
    for i, j in links:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    out, seen = [], set()
    for s in sorted(near):
        if s in seen:
            continue
        seen.add(s)
        part, todo = [], [s]
        while todo:
            x = todo.pop()
            part.append(x)
            todo += near[x] - seen
            seen |= near[x]
        out.append(sorted(part))
    return out


def join_singles(runs: list[list[int]]) -> Sections:
    """Where all runs are single slices, those that follow one another become one run; then
    one type a length, shortest first."""
    if all(len(r) == 1 for r in runs):
        joined: list[list[int]] = []
        for r in runs:
            if joined and r[0] == joined[-1][-1] + 1:
                joined[-1] = joined[-1] + r
            else:
                joined.append(r)
        runs = joined
    return [[r for r in runs if len(r) == n] for n in sorted({len(r) for r in runs})]


def join_adjacent(types: Sections) -> Sections:
    """Types whose occurrences always follow those of the type before become one."""
    out: Sections = []
    for t in types:
        last = out[-1] if out else []
        follows = {r[0]: r for r in t}
        if len(last) == len(t) and all(r[-1] + 1 in follows for r in last):
            out[-1] = [r + follows[r[-1] + 1] for r in last]
        else:
            out.append(t)
    return out


def sections_of(links, slices=()) -> Sections:
    """Section types by their first slice, each a list of runs of slices.

    Components of equal size that move on by one, slice for slice, make runs; single runs
    are joined, types split by length, and types that always follow one another joined.
    Slices without links are sections too. No slices make none."""
    chains: list[list[list[int]]] = []
    for c in components_of(links, slices):
        if chains and c == [x + 1 for x in chains[-1][-1]]:
            chains[-1].append(c)
        else:
            chains.append([c])
    types = [t for chain in chains for t in join_singles(sorted(map(list, zip(*chain))))]
    return join_adjacent(sorted(types, key=lambda t: min(map(min, t))))


def peel(cells: list[tuple[int, int, float]], *, least_distance: int = 0, most: int | None = None) -> list[list[tuple[int, int]]]:
    """Levels of links (i, j), i < j: j is i's strongest later slice and i is j's strongest
    earlier one (ties to the smaller slice; cells up to 0, or not farther off the diagonal
    than ``least_distance``, link nothing). A level's cells are gone for the next; the last
    level is the one after which nothing is mutual, or the ``most``-th."""
    later: dict = {}
    earlier: dict = {}
    for i, j, v in cells:
        if v > 0 and abs(i - j) > least_distance:
            (later if j > i else earlier).setdefault(i, []).append((-v, j))
    for side in (later, earlier):
        for x in side:
            side[x].sort(reverse=True)  # the strongest last, to be taken off
    gone: set = set()

    def best(side, x):
        row = side.get(x, [])
        while row and (min(x, row[-1][1]), max(x, row[-1][1])) in gone:
            row.pop()
        return row[-1][1] if row else None

    levels: list = []
    while most is None or len(levels) < most:
        found = [(i, j) for i in sorted(later) if (j := best(later, i)) is not None and best(earlier, j) == i]
        if not found:
            return levels
        levels.append(found)
        gone.update(found)
    return levels


def _numbered(found: Sections, *head) -> list[tuple]:
    return [(*head, s, t, o, p) for t, runs in enumerate(found) for o, r in enumerate(runs) for p, s in enumerate(r)]


_PLACES = ["slice", "section", "occurrence", "position"]


def _by_key(rows: DataFrame, keys: list[str], columns: list[str], run) -> DataFrame:
    """``run`` on the rows (i, j, n) of each key, a list of tuples of ``columns``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        key = tuple(pdf[k].iloc[0] for k in keys)
        found = run(list(zip(pdf["i"].tolist(), pdf["j"].tolist(), pdf["n"].tolist())))
        return pd.DataFrame([(*key, *r) for r in found], columns=[*keys, *columns])

    kept = rows.where(F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("n").isNotNull())
    kept = kept.select(*keys, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("n").cast("double").alias("n"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"{c} long" for c in columns])
    return kept.groupBy(*keys).applyInPandas(one, schema)


def _alone(slices: DataFrame, keys: list[str]) -> DataFrame:
    """Each slice beside itself: a cell that links nothing, so that all are known."""
    s = F.col("slice")
    return slices.select(*keys, s.alias("i"), s.alias("j"), F.lit(0.0).alias("n")).distinct()


def segmentation_levels(matrix: DataFrame, slices: DataFrame, keys: list[str], *, least_distance: int = 0, most: int | None = None) -> DataFrame:
    """keys, level, slice, section, occurrence, position: the sections of each level of
    mutual best links of ``matrix`` (keys, i, j, n) over all ``slices`` (keys, slice). A key
    without a mutual link has no levels."""

    def run(cells):
        every = sorted({i for i, _, _ in cells} | {j for _, j, _ in cells})
        levels = peel(cells, least_distance=least_distance, most=most)
        return [r for n, links in enumerate(levels) for r in _numbered(sections_of(links, every), n)]

    rows = matrix.select(*keys, "i", "j", F.col("n").cast("double").alias("n")).unionByName(_alone(slices, keys))
    return _by_key(rows, keys, ["level", *_PLACES], run)


def structure_by_types(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, label, type, occurrence of ``labels`` (keys, slice, label): slices of
    equal labels are a type, numbered in order of first appearance. Null labels are left out."""
    known = labels.where(F.col("label").isNotNull() & F.col("slice").isNotNull()).select(*keys, "slice", "label")
    first = known.groupBy(*keys, "label").agg(F.min("slice").alias("_first"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_first", "label")) - 1
    first = first.select(*keys, "label", number.cast("long").alias("type"))
    place = F.row_number().over(Window.partitionBy(*keys, "type").orderBy("slice")) - 1
    return known.join(first, [*keys, "label"]).withColumn("occurrence", place.cast("long"))


def alignment_segments(labels: DataFrame, keys: list[str], *, shortest: int = 8, gap: int = 0) -> DataFrame:
    """keys, lag, start, stop, matches: the stretches in which the labels (keys, slice,
    label) equal those ``lag`` slices later, at least ``shortest`` slices long, with up to
    ``gap`` slices between matches filled. Pairs of equal labels meet by label, so the work
    is the number of matching cells of each key's matrix. Null labels match nothing."""
    known = labels.where(F.col("label").isNotNull() & F.col("slice").isNotNull())
    one, other = (known.select(*keys, "label", F.col("slice").cast("long").alias(c)) for c in ("start", "_later"))
    cells = one.join(other, [*keys, "label"]).where("_later > start").select(*keys, (F.col("_later") - F.col("start")).alias("lag"), "start")
    row = Window.partitionBy(*keys, "lag").orderBy("start")
    fresh = F.coalesce((F.col("start") - F.lag("start").over(row) > gap + 1).cast("int"), F.lit(1))
    cells = cells.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(row))
    runs = cells.groupBy(*keys, "lag", "_run").agg(F.min("start").alias("start"), F.max("start").alias("stop"), F.count("*").alias("matches"))
    return runs.where(F.col("stop") - F.col("start") + 1 >= shortest).select(*keys, "lag", "start", "stop", "matches")


def structure_by_alignment(labels: DataFrame, keys: list[str], *, shortest: int = 8, gap: int = 0) -> DataFrame:
    """keys, slice, section, occurrence, position: sections whose slices are linked by the
    stretches of ``alignment_segments``."""
    runs = alignment_segments(labels, keys, shortest=shortest, gap=gap)
    cells = runs.select(*keys, F.explode(F.sequence("start", "stop")).alias("i"), "lag")
    cells = cells.select(*keys, "i", (F.col("i") + F.col("lag")).alias("j"), F.lit(1.0).alias("n"))
    slices = labels.where(F.col("slice").isNotNull()).select(*keys, F.col("slice").cast("long").alias("slice"))

    def run(found):
        return _numbered(sections_of([(i, j) for i, j, n in found if n], {i for i, _, _ in found}))

    return _by_key(cells.unionByName(_alone(slices, keys)), keys, _PLACES, run)
