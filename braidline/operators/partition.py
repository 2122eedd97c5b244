"""Slices of a graph: partition(node_id, slice[, version, time]), with its connection
matrix, validity filters and rating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .classes import Classes
from .components import connected_components


def connection_matrix(edges: DataFrame | Classes, partition: DataFrame, *, doubled_diagonal: bool = False) -> DataFrame:
    """i, j, n: edges between slices, both ways round; inside a slice each counts once
    (or twice, as a full recount of the published code has it). Where the edges join all
    nodes of a class, ``edges`` are the Classes, and the partition has their columns."""
    if isinstance(edges, Classes):
        return _both_ways(edges.cells(partition, "slice", []), doubled_diagonal)
    p = partition.select("node_id", "slice")
    e = edges.select("src", "dst").join(p.select(F.col("node_id").alias("src"), F.col("slice").alias("i")), "src")
    e = e.join(p.select(F.col("node_id").alias("dst"), F.col("slice").alias("j")), "dst")
    return _both_ways(e.groupBy("i", "j").agg(F.count("*").alias("n")), doubled_diagonal)


def _both_ways(n: DataFrame, doubled_diagonal: bool) -> DataFrame:
    turned = n.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "n")
    diagonal = F.when((F.col("i") == F.col("j")) & F.lit(doubled_diagonal), 2).otherwise(1)
    return n.unionByName(turned).groupBy("i", "j").agg(F.sum("n").alias("n")).withColumn("n", F.col("n") * diagonal)


def renumber(partition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Slices numbered from 0 without gaps. Distinct slices are few, so the numbering
    ranks them alone and is joined back."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy("slice") if keys else Window.orderBy("slice")
    ranks = partition.select(*keys, "slice").distinct().withColumn("_new", (F.row_number().over(w) - 1).cast("long"))
    return partition.join(ranks, [*keys, "slice"]).drop("slice").withColumnRenamed("_new", "slice")


def drop_small(partition: DataFrame, least: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    small = partition.groupBy(*keys, "slice").count().where(F.col("count") < least)
    return renumber(partition.join(small, [*keys, "slice"], "left_anti"), keys)


def merge(partition: DataFrame, i: int, j: int) -> DataFrame:
    """Slice j joined to i; later slices move up."""
    target = F.when(F.col("slice") == j, min(i, j)).when(F.col("slice") == i, min(i, j)).otherwise(F.col("slice"))
    return renumber(partition.withColumn("slice", target))


def merge_neighbours(partition: DataFrame) -> DataFrame:
    """Slices joined to the one before while the two share no version: a running merge
    over the (few) slices, on their version sets."""
    sets = partition.groupBy("slice").agg(F.collect_set("version").alias("v"))
    rows = sorted((r.slice, set(r.v)) for r in sets.collect())
    put, current, at = {}, None, -1
    for s, v in rows:
        if current is not None and not (current & v):
            current = current | v
        else:
            current, at = set(v), at + 1
        put[s] = at
    target = partition.sparkSession.createDataFrame(list(put.items()), "slice long, _new long")
    return partition.join(target, "slice").drop("slice").withColumnRenamed("_new", "slice")


def insert_slice(partition: DataFrame, nodes: DataFrame, index: int) -> DataFrame:
    """Nodes not yet placed, as a new slice at ``index``."""
    moved = partition.withColumn("slice", F.when(F.col("slice") >= index, F.col("slice") + 1).otherwise(F.col("slice")))
    new = nodes.join(partition.select("node_id"), "node_id", "left_anti").withColumn("slice", F.lit(index).cast("long"))
    return moved.unionByName(new, allowMissingColumns=True)


def one_per_version(partition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of a slice's nodes of one version, the earliest."""
    w = Window.partitionBy(*(keys or []), "slice", "version").orderBy("time")
    return partition.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_slices(partition: DataFrame) -> DataFrame:
    """Of a node's slices, the first."""
    w = Window.partitionBy("node_id").orderBy("slice")
    return partition.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def contradictions(partition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A version's earliest node of a slice where an earlier slice has a later time."""
    keys = keys or []
    first = partition.groupBy(*keys, "version", "slice").agg(F.min("time").alias("time"))
    w = Window.partitionBy(*keys, "version").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("latest_before", F.max("time").over(w)).where(F.col("latest_before") > F.col("time"))


def node_slice_edges(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """node_id, own, other, n: edges from a node into each slice."""
    p = partition.select("node_id", "slice")
    e = edges.select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    j = both.join(p.select(F.col("node_id").alias("src"), F.col("slice").alias("own")), "src").join(p.select(F.col("node_id").alias("dst"), F.col("slice").alias("other")), "dst")
    return j.groupBy(F.col("src").alias("node_id"), "own", "other").agg(F.count("*").alias("n"))


def affinity_outliers(edges: DataFrame | Classes, partition: DataFrame) -> DataFrame:
    """Nodes better connected to another slice than to their own."""
    if isinstance(edges, Classes):
        return edges.affinity_outliers(partition)
    n = node_slice_edges(edges, partition)
    best = n.groupBy("node_id", "own").agg(F.max("n").alias("best"), F.max(F.when(F.col("own") == F.col("other"), F.col("n"))).alias("own_n"))
    return best.where(F.col("best") > F.coalesce("own_n", F.lit(0))).select("node_id", F.col("own").alias("slice"), "best", F.coalesce("own_n", F.lit(0)).cast("long").alias("own_n"))


def inter_slice_edges(edges: DataFrame | Classes, partition: DataFrame, i: int, j: int) -> DataFrame:
    """Edges between two slices, by node and not by joined names."""
    if isinstance(edges, Classes):
        return edges.edges(partition.where(F.col("slice").isin(i, j)), "slice", where="slice1 <> slice2")
    p = partition.select("node_id", "slice").where(F.col("slice").isin(i, j))
    e = edges.join(p.select(F.col("node_id").alias("src"), F.col("slice").alias("s")), "src").join(p.select(F.col("node_id").alias("dst"), F.col("slice").alias("d")), "dst")
    return e.where("s <> d").drop("s", "d")


def direct_successors(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` one position behind a row of ``before`` in their version."""
    b = before.select("version", (F.col("time") + 1).alias("time"))
    return after.join(b, ["version", "time"], "left_semi")


def missing_nodes(nodes: DataFrame, partition: DataFrame) -> DataFrame:
    return nodes.join(partition.select("node_id"), "node_id", "left_anti")


def gap_sizes(cells: DataFrame, *, skip_first: bool = False) -> DataFrame:
    """i, j, gap: distances between successive non-zero bins of a row."""
    c = cells.where("n > 0" + (" AND j > 0" if skip_first else ""))
    w = Window.partitionBy("i").orderBy("j")
    return c.withColumn("gap", F.col("j") - F.lag("j").over(w)).where(F.col("gap").isNotNull()).select("i", "j", "gap")


def adjacent_sums(cells: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, mins, maxs: sums of the lesser and greater of neighbouring non-zero bins,
    row after row, over the total."""
    at = (F.col("i") * width + F.col("j")).cast("long")
    c = cells.where("n > 0").withColumn("_at", at)
    w = Window.partitionBy(*keys).orderBy("_at")
    c = c.withColumns({"_n": F.lag("n").over(w), "_p": F.lag("_at").over(w)})
    touch = F.col("_at") - F.col("_p") == 1
    return c.groupBy(*keys).agg(
        (F.sum(F.when(touch, F.least("n", "_n")).otherwise(0)) / F.sum("n")).alias("mins"),
        (F.sum(F.when(touch, F.greatest("n", "_n")).otherwise(0)) / F.sum("n")).alias("maxs"),
    )


def lone_diagonals(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, i, j: a non-zero cell and its diagonal successor, with nothing beside the
    first."""
    keys = keys or []
    c = cells.where("n > 0").select(*keys, "i", "j")
    on = [*keys, "i", "j"]
    d = c.join(c.select(*keys, (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j")), on, "left_semi")
    beside = c.select(*keys, "i", (F.col("j") + 1).alias("j")).unionByName(c.select(*keys, "i", (F.col("j") - 1).alias("j")))
    return d.join(beside, on, "left_anti")


def mask(cells: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Cells of at least ``threshold`` times the largest."""
    top = cells.agg(F.max("n").alias("_m"))
    return cells.join(F.broadcast(top), F.col("n") >= F.col("_m") * threshold).drop("_m")


def top_links(cells: DataFrame, n: int = 1, least_distance: int = 0) -> DataFrame:
    """Cells that are among the ``n`` largest of their row and of their column, ties kept."""
    c = cells.where((F.col("n") > 0) & (F.abs(F.col("i") - F.col("j")) > least_distance))
    rank = lambda by: F.rank().over(Window.partitionBy(by).orderBy(F.desc("n")))
    return c.withColumns({"_a": rank("i"), "_b": rank("j")}).where((F.col("_a") <= n) & (F.col("_b") <= n)).drop("_a", "_b")


FACTORS = ("node_count", "compactness", "self_connectedness", "connectedness", "non_empty", "gap_entropy", "gap_size", "adjacents_min", "adjacents_max", "diagonals")

#: The published exponents of the factors of a rating.
PRESETS = {
    "good": {"node_count": 0.5, "compactness": 0.2, "gap_entropy": -0.2, "adjacents_min": -0.2},
    "best": {"node_count": 1, "compactness": 0.1, "gap_entropy": -0.35, "adjacents_min": -0.35, "diagonals": 0.5},
    "test": {"node_count": 1, "compactness": 0.2, "gap_entropy": -0.35, "adjacents_min": -0.35, "diagonals": 0.5},
    "msa": {"node_count": 1, "compactness": 1, "gap_entropy": -1, "adjacents_min": -1, "diagonals": 1},
}


def sequence_rating(cells: DataFrame, partition: DataFrame, keys: list[str], width: int, preset: str = "msa") -> DataFrame:
    """keys, the ten FACTORS, rating: the product of the preset's factors to their powers,
    0 where one of them is undefined."""
    sizes = partition.groupBy(*keys, "slice").agg(F.count("*").alias("n"))
    base = sizes.groupBy(*keys).agg(
        F.sum("n").alias("node_count"), (F.avg("n") / (1 + F.coalesce(F.stddev_samp("n"), F.lit(0.0)))).alias("compactness"), F.count("*").alias("_slices")
    )
    filled = cells.where("n > 0")
    links = filled.groupBy(*keys).agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("n")).otherwise(0)).alias("_own"), F.avg("n").alias("connectedness"), F.count("*").alias("_bins"))
    w = Window.partitionBy(*keys, "i").orderBy("j")
    gaps = filled.withColumn("gap", F.col("j") - F.lag("j").over(w)).where(F.col("gap").isNotNull())
    hist = gaps.groupBy(*keys, "gap").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(Window.partitionBy(*keys)))
    entropy = hist.groupBy(*keys).agg((1 - F.sum(F.col("p") * F.ln("p"))).alias("gap_entropy"), (F.sum(F.col("gap") * F.col("p")) / F.max("gap")).alias("gap_size"))
    near = adjacent_sums(cells, keys, width).select(*keys, (1 + F.col("mins")).alias("adjacents_min"), (1 + F.col("maxs")).alias("adjacents_max"))
    lone = lone_diagonals(cells, keys).groupBy(*keys).agg(F.count("*").alias("_lone"))
    all_ = base.join(links, keys, "left").join(entropy, keys, "left").join(near, keys, "left").join(lone, keys, "left")
    all_ = all_.withColumns(
        {
            "self_connectedness": F.col("_own") / F.col("_slices"),
            "non_empty": F.col("_bins") / (F.col("_slices") * F.col("_slices")),
            "diagonals": 1 + F.coalesce("_lone", F.lit(0)) / (F.coalesce("_bins", F.lit(0)) + 1),
        }
    )
    rating = F.lit(1.0)
    for name, power in PRESETS[preset].items():
        rating = rating * F.pow(F.col(name), F.lit(float(power)))
    return all_.select(*keys, *FACTORS, F.coalesce(F.nanvl(rating, F.lit(0.0)), F.lit(0.0)).alias("rating"))


def ensure_valid(partition: DataFrame, keys: list[str], *, least: int = 2) -> DataFrame:
    """One node a version and slice, no node behind a later one of an earlier slice, and
    slices of at least ``least`` nodes, renumbered."""
    p = one_per_version(partition, keys)
    wrong = contradictions(p, keys).select(*keys, "version", "slice")
    return drop_small(p.join(wrong, [*keys, "version", "slice"], "left_anti"), least, keys)


def _inner_links(edges: DataFrame, partition: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slice, a, b: links between different nodes of a slice, both ways round."""
    p = partition.select(*keys, "slice", "node_id")
    one = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    met = both.join(p.withColumnRenamed("node_id", "a"), "a")
    return met.join(p.withColumnRenamed("node_id", "b"), [*keys, "slice", "b"], "left_semi").select(*keys, "slice", "a", "b")


def linked_nodes(edges: DataFrame | Classes, partition: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes with a link inside their slice."""
    if isinstance(edges, Classes):
        return edges.linked_nodes(partition, keys)
    linked = _inner_links(edges, partition, keys).select(*keys, "slice", F.col("a").alias("node_id")).distinct()
    return partition.join(linked, [*keys, "slice", "node_id"], "left_semi")


def largest_components(edges: DataFrame | Classes, partition: DataFrame, keys: list[str]) -> DataFrame:
    """Each slice's largest component, ties to the one with the smallest node."""
    if isinstance(edges, Classes):
        return edges.largest_components(partition, keys)
    spot = lambda c: F.concat_ws("@", *keys, "slice", c)
    links = _inner_links(edges, partition, keys).select(spot("a").alias("src"), spot("b").alias("dst"))
    of = connected_components(links)
    p = partition.withColumn("_at", spot("node_id")).join(of, F.col("_at") == F.col("node"), "left").withColumn("_c", F.coalesce("component", "_at")).drop("component", "node", "_at")
    sizes = p.groupBy(*keys, "slice", "_c").agg(F.count("*").alias("_n"), F.min("node_id").alias("_first"))
    w = Window.partitionBy(*keys, "slice").orderBy(F.desc("_n"), "_first")
    top = sizes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "slice", "_c")
    return p.join(top, [*keys, "slice", "_c"], "left_semi").drop("_c")


def out_of_order(partition: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, slice of both sides of contradictions: a version's earliest node of
    a slice that some slice before is later than, and the first such slice."""
    first = partition.groupBy(*keys, "version", "slice").agg(F.min("time").alias("time"))
    rows = first.groupBy(*keys, "version").agg(F.array_sort(F.collect_list(F.struct("slice", "time"))).alias("s"))
    sides = F.expr("flatten(transform(s, (n, i) -> transform(slice(filter(slice(s, 1, i), t -> t.time > n.time), 1, 1), t -> array(t.slice, n.slice))))")
    return rows.select(*keys, "version", F.explode(F.array_distinct(F.flatten(sides))).alias("slice"))


CONSTRAINTS = ("connected", "component", "affinity", "versions", "uniqueness", "order")


def constrain(edges: DataFrame | Classes, partition: DataFrame, keys: list[str], *, constraints=CONSTRAINTS, size_factor: float | None = None) -> DataFrame:
    """The slices (keys, slice, node_id, version, time) that keep the constraints, taken in
    the order of CONSTRAINTS: links inside the slice, its largest component, no better
    linked slice, a node a version, a slice a node, times in order (both sides of a
    contradiction go); then slices of at least the largest's size over ``size_factor``."""
    # each step reads the one before more than once
    p = materialise(partition, "constrain")
    if not isinstance(edges, Classes):
        edges = materialise(edges.select("src", "dst"), "constrain")
    if "connected" in constraints:
        p = materialise(linked_nodes(edges, p, keys), "constrain")
    if "component" in constraints:
        p = materialise(largest_components(edges, p, keys), "constrain")
    if "affinity" in constraints:
        p = materialise(p.join(affinity_outliers(edges, p).select("node_id", "slice"), ["node_id", "slice"], "left_anti"), "constrain")
    if "versions" in constraints:
        p = one_per_version(p, keys)
    if "uniqueness" in constraints:
        p = unique_slices(p)
    if "order" in constraints:
        p = materialise(p, "constrain")
        p = materialise(p.join(out_of_order(p, keys), [*keys, "version", "slice"], "left_anti"), "constrain")
    if size_factor:
        n = p.groupBy(*keys, "slice").agg(F.count("*").alias("_n"))
        top = F.max("_n").over(Window.partitionBy(*keys))
        p = p.join(n.withColumn("_m", top).where(F.col("_n") >= F.col("_m") / size_factor), [*keys, "slice"], "left_semi")
    return renumber(p, keys)


def place_node(partition: DataFrame, nodes: DataFrame, index: int) -> DataFrame:
    """``nodes`` (as the partition, without slice) put into slice ``index``, but for those
    that are placed already."""
    new = nodes.join(partition.select("node_id"), "node_id", "left_anti").withColumn("slice", F.lit(index).cast("long"))
    return partition.unionByName(new, allowMissingColumns=True)


def take_nodes(partition: DataFrame, nodes: DataFrame, index: int | None = None) -> DataFrame:
    """Without ``nodes``, or without them in slice ``index``."""
    gone = nodes.select("node_id")
    if index is None:
        return partition.join(gone, "node_id", "left_anti")
    return partition.join(gone.withColumn("slice", F.lit(index).cast("long")), ["node_id", "slice"], "left_anti")


def move_nodes(partition: DataFrame, nodes: DataFrame, to: int) -> DataFrame:
    """``nodes`` moved from wherever they are to slice ``to``."""
    gone = nodes.select("node_id", F.lit(True).alias("_g")).distinct()
    moved = F.when(F.col("_g"), F.lit(to).cast("long")).otherwise(F.col("slice"))
    return partition.join(gone, "node_id", "left").withColumn("slice", moved).drop("_g").distinct()


def slice_sizes(partition: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slices, nodes, largest."""
    n = partition.groupBy(*keys, "slice").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.count("*").alias("slices"), F.sum("n").alias("nodes"), F.max("n").alias("largest"))
