"""Graphs whose edges join all nodes of a class, worked by the class: no edge is listed
unless it is the result.

A class are the rows that agree in all columns ``by``; ``order`` directs an edge from the
smaller to the larger. A row with a null among these has no edge. A class of n rows has
n * (n - 1) / 2 edges, but what is asked of the graph mostly follows from counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classes:
    """by, order, id: names of columns. ``order`` is distinct within a class."""

    by: tuple[str, ...]
    order: str
    id: str = "id"

    def _whole(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*self.by, self.order)])

    def _least(self) -> Column:
        """Null-safe: the columns that part rows, with a row without a class on its own."""
        return F.when(~self._whole(), F.col(self.id))

    def sizes(self, nodes: DataFrame) -> DataFrame:
        """nodes with ``members``: the rows of their class, themselves included."""
        w = Window.partitionBy(*self.by)
        return nodes.withColumn("members", F.when(self._whole(), F.count(F.when(self._whole(), 1)).over(w)).otherwise(1))

    def degrees(self, nodes: DataFrame) -> DataFrame:
        return self.sizes(nodes).select(self.id, (F.col("members") - 1).cast("long").alias("degree"))

    def isolated(self, nodes: DataFrame) -> DataFrame:
        return self.sizes(nodes).where("members = 1").drop("members")

    def components(self, nodes: DataFrame) -> DataFrame:
        """id, component: the smallest id of the class."""
        w = Window.partitionBy(*self.by)
        return nodes.select(self.id, F.when(self._whole(), F.min(F.when(self._whole(), F.col(self.id))).over(w)).otherwise(F.col(self.id)).alias("component"))

    def members(self, nodes: DataFrame) -> DataFrame:
        """members: the ids of each class, sorted; these are the graph's maximal cliques."""
        grouped = nodes.groupBy(*self.by, self._least().alias("_alone"))
        return grouped.agg(F.array_sort(F.collect_list(self.id)).alias("members")).select("members")

    def cover(self, nodes: DataFrame) -> DataFrame:
        """center, members: a class is covered by the group of any of its nodes, so by that
        of the smallest."""
        return self.members(nodes).select(F.col("members")[0].alias("center"), "members")

    def groups(self, nodes: DataFrame, keys: list[str], count: int) -> DataFrame:
        """keys, rank (from 0) and the nodes' other columns of the ``count`` largest classes
        with an edge of each of ``keys`` (among ``by``), ties to the one with the smallest
        node. A class is the best group of each of its nodes, and taking it out isolates no
        node of another: so these are the most linked groups, taken one after another."""
        rows = nodes.where(self._whole())
        first = F.min(F.struct(self.order, *[c for c in self.by if c not in keys])).alias("_first")
        sizes = rows.groupBy(*self.by).agg(F.count("*").alias("_n"), first).where("_n > 1")
        w = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first")
        top = sizes.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)
        top = top.select(*self.by, (F.col("rank") - 1).cast("long").alias("rank"))
        return rows.join(F.broadcast(top), list(self.by)).select(*keys, "rank", *[c for c in nodes.columns if c not in keys])

    def edges(self, nodes: DataFrame, *more: str, where: str | None = None) -> DataFrame:
        """src, dst (and a's and b's columns ``more`` as c1, c2 for a test) of all pairs of
        nodes of a class. Nodes are to be filtered before they come here."""
        side = lambda n, end: nodes.where(self._whole()).select(*self.by, F.col(self.order).alias(f"_o{n}"), F.col(self.id).alias(end), *[F.col(c).alias(f"{c}{n}") for c in more])
        met = side(1, "src").join(side(2, "dst"), list(self.by)).where("_o1 < _o2")
        return (met.where(where) if where else met).select("src", "dst")

    def cells(self, nodes: DataFrame, slice: str, keys: list[str]) -> DataFrame:
        """keys, i, j, n: edges from slice i to slice j. A task counts a class, in the order
        of its rows; ``keys`` are among ``by``."""
        rows = nodes.where(self._whole()).select(*self.by, F.col(self.order).alias("_o"), F.col(slice).cast("long").alias("_s"))
        keep = list(self.by)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import numpy as np

            t = pa.Table.from_batches(list(batches)).sort_by("_o")
            s = t["_s"].combine_chunks()
            names, at = np.unique(s.fill_null(0).to_numpy(zero_copy_only=False), return_inverse=True)
            at = np.where(s.is_null().to_numpy(zero_copy_only=False), len(names), at)  # null is a slice of its own
            k = len(names) + 1
            before, n = np.zeros(k, np.int64), np.zeros((k, k), np.int64)
            for x in range(0, len(at), 4096):
                part = at[x : x + 4096]
                one = np.zeros((len(part), k), np.int64)
                one[np.arange(len(part)), part] = 1
                ahead = before + one.cumsum(0) - one
                np.add.at(n, part, ahead)  # n[j, i]
                before += one.sum(0)
            j, i = np.nonzero(n)
            label = lambda v: pa.array(np.append(names, 0)[v], pa.int64(), mask=v == k - 1)
            first = [pa.array([t[c][0].as_py()] * len(i), t.schema.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*first, label(i), label(j), pa.array(n[j, i])], names=[*keep, "i", "j", "n"])

        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
        found = rows.groupBy(*self.by).applyInArrow(run, f"{kinds}, i long, j long, n long")
        return found.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))

    def _counts(self, partition: DataFrame) -> DataFrame:
        return partition.where(self._whole()).groupBy(*self.by, "slice").agg(F.count("*").alias("n"))

    def affinity_outliers(self, partition: DataFrame) -> DataFrame:
        """node_id, slice, best, own_n of nodes with more edges to another slice than inside
        their own, counted by class and slice."""
        n = self._counts(partition)
        own, other = n.withColumnRenamed("slice", "own").drop("n"), n.withColumnRenamed("slice", "other")
        to = own.join(other, list(self.by)).withColumn("n", F.col("n") - F.when(F.col("own").eqNullSafe(F.col("other")), 1).otherwise(0)).where("n > 0")
        best = to.groupBy(*self.by, "own").agg(F.max("n").alias("best"), F.coalesce(F.max(F.when(F.col("own") == F.col("other"), F.col("n"))), F.lit(0)).cast("long").alias("own_n"))
        best = best.where("best > own_n").select(*[F.col(c).alias(f"_{c}") for c in self.by], "own", "best", "own_n")
        on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in self.by]) & F.col("slice").eqNullSafe(F.col("own"))
        return partition.where(self._whole()).join(best, on).select("node_id", "slice", "best", "own_n")

    def linked_nodes(self, partition: DataFrame, keys: list[str]) -> DataFrame:
        """Nodes with an edge inside their slice."""
        w = Window.partitionBy(*dict.fromkeys([*keys, *self.by, "slice"]))
        kept = partition.where(self._whole() & F.col("slice").isNotNull())
        return kept.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")

    def largest_components(self, partition: DataFrame, keys: list[str]) -> DataFrame:
        """Each slice's largest class, ties to the one with the smallest node; a node with no
        class is one of its own."""
        parts = [*dict.fromkeys([*keys, "slice", *self.by])]
        alone = self._least().alias("_alone")
        sizes = partition.groupBy(*parts, alone).agg(F.count("*").alias("_n"), F.min("node_id").alias("_first"))
        w = Window.partitionBy(*keys, "slice").orderBy(F.desc("_n"), "_first")
        top = sizes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*[F.col(c).alias(f"_{c}") for c in parts], F.col("_alone").alias("__alone"))
        same = lambda c: F.col(c) == F.col(f"_{c}") if c in (*keys, "slice") else F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = reduce(lambda a, b: a & b, map(same, parts)) & self._least().eqNullSafe(F.col("__alone"))
        return partition.join(top, on, "left_semi")
