"""Hierarchies as parts(parent, child, ord): averages by level, and trees of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise


def levels(parts: DataFrame, *, most: int = 64) -> DataFrame:
    """id, level: 0 for roots, one more than the parent for others."""
    roots = parts.select(F.col("parent").alias("id")).distinct().join(parts.select(F.col("child").alias("id")), "id", "left_anti")
    front = found = materialise(roots.withColumn("level", F.lit(0)), "levels")
    for n in range(1, most):
        front = materialise(front.join(parts, F.col("id") == F.col("parent")).select(F.col("child").alias("id"), F.lit(n).alias("level")).distinct(), "levels")
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found.groupBy("id").agg(F.max("level").alias("level"))


def averages(parts: DataFrame, leaves: DataFrame) -> DataFrame:
    """id, value: leaves' own values, and each parent's mean of its children's."""
    at = levels(parts)
    deepest = at.agg(F.max("level")).first()[0] or 0
    known = leaves.select("id", "value")
    for n in range(deepest - 1, -1, -1):
        here = parts.join(at.where(F.col("level") == n), F.col("parent") == F.col("id")).select("parent", "child")
        means = here.join(known, F.col("child") == known["id"]).groupBy("parent").agg(F.avg("value").alias("value"))
        known = materialise(known.unionByName(means.select(F.col("parent").alias("id"), "value")), "averages")
    return known


def pattern_parts(occurrences: DataFrame) -> DataFrame:
    """parent, child, ord: a song's parts are its patterns, a pattern's its occurrences,
    an occurrence's its points; occurrences(song, pattern, occ, point)."""
    name = lambda *c: F.concat_ws("/", *c)
    o = occurrences
    top = o.select(F.col("song").cast("string").alias("parent"), name("song", "pattern").alias("child"), F.col("pattern").cast("long").alias("ord")).distinct()
    mid = o.select(name("song", "pattern").alias("parent"), name("song", "pattern", "occ").alias("child"), F.col("occ").cast("long").alias("ord")).distinct()
    low = o.select(name("song", "pattern", "occ").alias("parent"), name("song", "pattern", "occ", "point").alias("child"), F.col("point").cast("long").alias("ord"))
    return top.unionByName(mid).unionByName(low)
