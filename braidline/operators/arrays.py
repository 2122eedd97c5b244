"""Set, multiset, matrix and naming helpers as columns and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_sets(a: Column, b: Column, *, one_sided: bool = False) -> Column:
    """Same elements; ``one_sided`` is the published test, which asks only that b's are
    among a's."""
    inside = F.size(F.array_except(b, a)) == 0
    return inside if one_sided else inside & (F.size(F.array_except(a, b)) == 0)


def proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def multiset_common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common, each as often as in the poorer one."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))


def multiset_union(a: Column, b: Column) -> Column:
    return F.size(a) + F.size(b) - multiset_common(a, b)


def powerset(a: Column) -> Column:
    """All subsets, in the order of their elements' places; for sets of up to 20."""
    n = F.pow(F.lit(2), F.size(a)).cast("int")
    chosen = lambda mask: F.filter(a, lambda x, i: F.pmod(F.floor(mask / F.pow(F.lit(2), i)), F.lit(2)) == 1)
    return F.transform(F.sequence(F.lit(0), n - 1), chosen)


def combinations(options: dict[str, list]) -> list[dict]:
    """Every combination of named values, the last name fastest."""
    out = [{}]
    for name, values in options.items():
        out = [{**c, name: v} for c in out for v in values]
    return out


def closest_index(values: Column, x: Column) -> Column:
    """Place of the value nearest to x, the first of equals."""
    d = F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i")))
    return F.array_min(d)["i"]


def to_grid(events: DataFrame, grid: DataFrame, key: str, *, rounded: bool = False) -> DataFrame:
    """Events (start, end) as ranges of grid places (key, at, place): from the last place
    at or before the start to the one before the end, or the nearest if rounded."""
    from .interval import as_of, nearest

    snap = (lambda d, c: nearest(d.withColumn("at", F.col(c)), grid, key, "at", "place")) if rounded else (lambda d, c: as_of(d.withColumn("at", F.col(c)), grid, key, "at", "place"))
    first = snap(events, "start").withColumnRenamed("place", "first").drop("at")
    last = snap(first, "end").withColumnRenamed("place", "last").drop("at")
    inside = F.when(F.col("last") > F.col("first"), F.sequence("first", F.col("last") - 1)).otherwise(F.array().cast("array<bigint>"))
    return last.withColumn("places", inside)


def same_length(occurrences: DataFrame, key: str) -> DataFrame:
    """Occurrences (key, start, length) with the commonest length of their pattern, ties
    to the one seen last."""
    n = occurrences.groupBy(key, "length").agg(F.count("*").alias("n"), F.min("start").alias("seen"))
    mode = n.groupBy(key).agg(F.max_by("length", F.struct("n", "seen")).alias("length"))
    return occurrences.drop("length").join(mode, key)


def diagonal(cells: DataFrame) -> DataFrame:
    return cells.where("i = j")


def add_matrices(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("n").alias("n"))


def cell_products(matrices: DataFrame, versions: int) -> DataFrame:
    """i, j, v: products of a cell over versions; what a version lacks counts as one."""
    zero = F.max((F.col("v") == 0).cast("int"))
    sign = F.when(F.sum((F.col("v") < 0).cast("int")) % 2 == 1, -1.0).otherwise(1.0)
    logs = F.sum(F.when(F.col("v") != 0, F.ln(F.abs("v"))))
    return matrices.groupBy("i", "j").agg(F.when(zero == 1, 0.0).otherwise(sign * F.exp(logs)).alias("v"))


def unique_name(path: Column) -> Column:
    """The last two parts of a path, joined, dots as underscores."""
    parts = F.split(path, "/")
    return F.regexp_replace(F.concat_ws("_", F.slice(parts, -2, 2)), "[.]", "_")


def first_bins(hist: DataFrame, key: str, bins: int, *, by_name: bool = False) -> DataFrame:
    """The first bins of each histogram, in order of values, or of their names."""
    order = F.col("value").cast("string") if by_name else F.col("value")
    return hist.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= bins).drop("_r")


def time_votes(part: DataFrame) -> DataFrame:
    """i, j, votes: in how many versions slice i's time is before slice j's, less those
    the other way round."""
    p = part.groupBy("version", "slice").agg(F.min("time").alias("time"))
    a = p.select("version", F.col("slice").alias("i"), F.col("time").alias("ti"))
    b = p.select("version", F.col("slice").alias("j"), F.col("time").alias("tj"))
    return a.join(b, "version").where("i <> j").groupBy("i", "j").agg(F.sum(F.signum(F.col("tj") - F.col("ti"))).cast("long").alias("votes"))


def in_time_order(part: DataFrame) -> DataFrame:
    """slice, place: slices by how many others they precede by a majority of votes."""
    wins = time_votes(part).groupBy("i").agg(F.sum((F.col("votes") > 0).cast("int")).alias("wins"))
    every = part.select("slice").distinct().join(wins, F.col("slice") == F.col("i"), "left")
    return every.select("slice", (F.row_number().over(Window.orderBy(F.desc_nulls_last("wins"), "slice")) - 1).cast("long").alias("place"))


def painted(occurrences: DataFrame) -> DataFrame:
    """version, time, type: positions under occurrences (version, start, length, type);
    of types on one position the largest stays."""
    each = occurrences.select("version", "type", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("time"))
    return each.groupBy("version", "time").agg(F.max("type").alias("type"))
