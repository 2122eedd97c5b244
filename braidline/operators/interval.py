"""Interval, as-of and nearest joins within a key.

A theta join inside one long recording would compare all its rows, so the joins below
deal both sides into time buckets and meet by equality of (key, bucket) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.greatest(F.floor(start / width), F.floor(end / width))))


def overlap_argmax(segments: DataFrame, labels: DataFrame, key: str, *, width: float) -> DataFrame:
    """key, i, label, overlap: for each segment (i, start, end) the label (idx, start,
    end, label) with the largest overlap, ties to the first. Segments that overlap none
    take the nearest label before them, else after them."""
    s = segments.select(key, "i", F.col("start").alias("s0"), F.col("end").alias("s1"))
    l = labels.select(key, "idx", "label", F.col("start").alias("l0"), F.col("end").alias("l1"))
    met = s.withColumn("_b", _buckets(F.col("s0"), F.col("s1"), width)).join(l.withColumn("_b", _buckets(F.col("l0"), F.col("l1"), width)), [key, "_b"])
    over = F.least("s1", "l1") - F.greatest("s0", "l0")
    met = met.withColumn("overlap", over).where("overlap > 0")
    best = met.groupBy(key, "i").agg(F.max_by("label", F.struct("overlap", -F.col("idx"))).alias("label"), F.max("overlap").alias("overlap"))
    rest = s.join(best.select(key, "i"), [key, "i"], "left_anti").select(key, "i", F.col("s0").alias("_at"))
    before = as_of(rest, l.select(key, F.col("l0").alias("_at"), "label"), key, "_at", "label")
    first = l.groupBy(key).agg(F.min_by("label", F.struct("l0", "idx")).alias("_first"))
    near = before.join(first, key, "left").select(key, "i", F.coalesce("label", "_first").alias("label"), F.lit(0.0).alias("overlap"))
    return best.unionByName(near)


def group_events(segments: DataFrame, events: DataFrame, key: str, *, width: float) -> DataFrame:
    """Segments (i, start, end) with each event (start, duration, value) that starts in
    them or still sounds when they begin."""
    e = events.select(key, F.col("start").alias("e0"), (F.col("start") + F.col("duration")).alias("e1"), "value")
    s = segments.select(key, "i", F.col("start").alias("s0"), F.col("end").alias("s1"))
    met = s.withColumn("_b", _buckets(F.col("s0"), F.col("s1"), width)).join(e.withColumn("_b", _buckets(F.col("e0"), F.col("e1"), width)), [key, "_b"])
    inside = ((F.col("e0") >= F.col("s0")) & (F.col("e0") < F.col("s1"))) | ((F.col("e0") < F.col("s0")) & (F.col("s0") <= F.col("e1")))
    # a pair shares several buckets; it counts in the first of them
    first = F.greatest(F.floor(F.col("s0") / width), F.floor(F.col("e0") / width))
    return met.where(inside & (F.col("_b") == first)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Left rows with the last right value at or before them: one shuffle on the key and
    a running last over both sides."""
    both = left.withColumn("_l", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_l", F.lit(0)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_l = 1").drop("_l", "_v")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, idx: str) -> DataFrame:
    """Left rows with the idx of the nearest right row, ties to the earlier one."""
    r = right.select(key, at, F.struct(F.col(at).alias("t"), F.col(idx).alias("n")).alias("_v")).withColumn("_l", F.lit(0))
    both = left.withColumn("_l", F.lit(1)).unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(at, F.desc("_l")).rowsBetween(0, Window.unboundedFollowing)
    d = both.withColumns({"_p": F.last("_v", ignorenulls=True).over(back), "_n": F.first("_v", ignorenulls=True).over(ahead)}).where("_l = 1")
    later = F.col("_p").isNull() | (F.col("_n.t") - F.col(at) < F.col(at) - F.col("_p.t"))
    return d.withColumn(idx, F.when(later & F.col("_n").isNotNull(), F.col("_n.n")).otherwise(F.col("_p.n"))).drop("_l", "_v", "_p", "_n")


def meter_phase(snapped: DataFrame, key: str, idx: str, meter: int = 4) -> DataFrame:
    """key, phase, votes: the commonest index modulo the meter, ties to the smaller."""
    n = snapped.groupBy(key, F.pmod(F.col(idx), F.lit(meter)).alias("phase")).agg(F.count("*").alias("votes"))
    w = Window.partitionBy(key).orderBy(F.desc("votes"), "phase")
    return n.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def coverage(found: DataFrame, truth: DataFrame) -> DataFrame:
    """pattern, gt, coverage: how much of each true pattern's segments (gt, seg, s0, s1)
    a found pattern's occurrences (pattern, occ, o0, o1; ends inclusive) cover, counting
    offsets that recur."""
    a = truth.select("gt", "seg", "s0", "s1")
    b = found.select("pattern", "occ", "o0", "o1")
    w = 64
    met = a.withColumn("_b", _buckets(F.col("s0"), F.col("s1"), w)).join(b.withColumn("_b", _buckets(F.col("o0"), F.col("o1"), w)), "_b")
    touch = F.col("o0").between(F.col("s0"), F.col("s1")) | F.col("o1").between(F.col("s0"), F.col("s1")) | ((F.col("o0") < F.col("s0")) & (F.col("o1") > F.col("s1")))
    first = met.where(touch).groupBy("pattern", "gt", "seg", "s0", "s1").agg(F.min(F.struct("occ", "o0", "o1")).alias("o"))
    first = first.withColumn("offset", F.col("o.o0") - F.col("s0"))
    share = (F.least("s1", "o.o1") - F.greatest("s0", "o.o0") + 1) / (F.col("s1") - F.col("s0") + 1)
    # an offset's shares are summed and counted together, so that no row is exchanged for it
    recurs = first.groupBy("pattern", "gt", "offset").agg(F.sum(share).alias("share"), F.count("*").alias("n"))
    sums = recurs.groupBy("pattern", "gt").agg(F.sum(F.when(F.col("n") > 1, F.col("share")).otherwise(0.0)).alias("total"))
    sizes = truth.groupBy("gt").agg(F.count("*").alias("segs"))
    return sums.join(sizes, "gt").select("pattern", "gt", (F.col("total") / F.col("segs")).alias("coverage"))


def evaluate(covered: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    """best (the mean over true patterns of the largest coverage) and means (of all
    coverages); patterns that do not meet cover nothing."""
    n = truth.agg(F.countDistinct("gt").alias("g")).crossJoin(found.agg(F.countDistinct("pattern").alias("p")))
    per = covered.groupBy("gt").agg(F.max("coverage").alias("m"), F.sum("coverage").alias("s")).agg(F.sum("m").alias("m"), F.sum("s").alias("s"))
    return per.crossJoin(n).select((F.coalesce("m", F.lit(0.0)) / F.col("g")).alias("best"), (F.coalesce("s", F.lit(0.0)) / (F.col("g") * F.col("p"))).alias("means"))


def grid_error(onsets, offset: float, unit: float) -> float:
    """Distances from onsets to the grid, and from grid points to the nearest onset."""
    import numpy as np

    x = np.sort(np.asarray(onsets, float))
    grid = np.arange(offset, x[-1] + unit / 2, unit)
    near = lambda a, b: np.abs(a[:, None] - b[None]).min(1).sum() if len(a) and len(b) else 0.0
    return float(near(x, grid) + near(grid, x))


def _grid_errors(x, found) -> list[float]:
    """``grid_error`` of every (offset, unit), those of equally long grids at once."""
    import numpy as np

    offsets, units = np.array([o for o, _ in found]), np.array([u for _, u in found])
    lengths = np.ceil((x[-1] + units / 2 - offsets) / units).astype(int)
    out = np.zeros(len(found))
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        few = max(1, 1_000_000 // (len(x) * max(n, 1)))
        for i in range(0, len(rows) if n > 0 else 0, few):
            part = rows[i : i + few]
            o, u = offsets[part, None], units[part, None]
            apart = np.abs(x[:, None] - (o + ((o + u) - o) * np.arange(n))[:, None, :])  # steps as arange has them
            out[part] = apart.min(2).sum(1) + apart.min(1).sum(1)
    return out.tolist()


def fit_grid(onsets, *, unit: float | None = None, width: int = 5, steps: int = 10, until: float = 1e-4) -> tuple[float, float]:
    """Offset and unit of the regular grid closest to onsets: a beam over a lattice of
    both that narrows around its best points."""
    import numpy as np

    x = np.sort(np.asarray(onsets, float))
    if len(x) < 2:
        return (float(x[0]) if len(x) else 0.0), 1.0
    unit = unit or float(np.median(np.diff(x))) or 1.0
    beam, span = [(grid_error(x, x[0], unit), float(x[0]), unit)], unit / 2
    while span > until:
        found = {}
        for _, o, u in beam:
            for a in np.linspace(-span, span, steps + 1):
                for b in np.linspace(-span / len(x), span / len(x), steps + 1):
                    if u + b > unit / 4:
                        found[(o + a, u + b)] = None
        scored = sorted(zip(_grid_errors(x, list(found)), *zip(*found)))
        beam = (scored + beam)[:width] if scored[0][0] > beam[0][0] else scored[:width]
        span /= 4
    _, offset, unit = beam[0]
    return float(offset), float(unit)
