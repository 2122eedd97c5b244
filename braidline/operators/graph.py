"""Multigraphs as two tables: nodes(id, ...) and edges(eid, src, dst)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .blocks import code_sets, touching
from .components import connected_components


@dataclass(frozen=True)
class Graph:
    """Edges without both ends among the nodes are left out; the first of equal ids stays."""

    nodes: DataFrame
    edges: DataFrame

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> "Graph":
        nodes = nodes.dropDuplicates(["id"])
        ids = nodes.select("id")
        kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(nodes, kept)

    def subgraph(self, ids: DataFrame) -> "Graph":
        """Induced by ``ids`` (a column id)."""
        return Graph.of(self.nodes.join(ids.select("id").distinct(), "id", "left_semi"), self.edges)

    def without(self, ids: DataFrame | None = None, eids: DataFrame | None = None) -> "Graph":
        nodes = self.nodes if ids is None else self.nodes.join(ids.select("id"), "id", "left_anti")
        edges = self.edges if eids is None else self.edges.join(eids.select("eid"), "eid", "left_anti")
        return Graph.of(nodes, edges)

    def add(self, other: "Graph") -> "Graph":
        return Graph.of(self.nodes.unionByName(other.nodes, allowMissingColumns=True), self.edges.unionByName(other.edges, allowMissingColumns=True))

    def both_ways(self) -> DataFrame:
        """id, other: distinct neighbours in either direction."""
        e = self.edges
        out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"))
        return out.unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("other"))).distinct()

    def ends(self) -> DataFrame:
        e = self.edges
        return e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id"))

    def degrees(self) -> DataFrame:
        """id, degree: edges that touch a node; a self loop counts once."""
        n = self.ends().groupBy("id").agg(F.count("*").alias("degree"))
        return self.nodes.select("id").join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def isolated(self) -> DataFrame:
        return self.nodes.join(self.ends().distinct(), "id", "left_anti")

    def incident(self) -> "Graph":
        return Graph(self.nodes.join(self.ends().distinct(), "id", "left_semi"), self.edges)

    def bidirectional(self, *, at_least: int = 1) -> DataFrame:
        """Edges with at least so many in the other direction."""
        back = self.edges.groupBy(F.col("dst").alias("src"), F.col("src").alias("dst")).agg(F.count("*").alias("_n"))
        return self.edges.join(back.where(F.col("_n") >= at_least), ["src", "dst"], "left_semi")

    def adjacents(self, sources: DataFrame, hops: int) -> DataFrame:
        """source, id: nodes within so many hops, the source left out."""
        step = self.both_ways()
        seen = sources.select(F.col("id").alias("source"), F.col("id"))
        front = seen
        for _ in range(hops):
            front = front.join(step, "id").select("source", F.col("other").alias("id")).distinct().join(seen, ["source", "id"], "left_anti")
            front = materialise(front, "adjacents") if hops > 2 else front
            seen = seen.unionByName(front)
        return seen.where("source <> id")

    def distances(self, sources: DataFrame, *, most: int = 1000) -> DataFrame:
        """source, id, distance by breadth first search over undirected edges."""
        step = materialise(self.both_ways(), "bfs-steps")  # every round reads it
        seen = materialise(sources.select(F.col("id").alias("source"), F.col("id"), F.lit(0).alias("distance")), "bfs")
        front = seen
        for d in range(1, most + 1):
            front = front.join(step, "id").select("source", F.col("other").alias("id")).distinct().join(seen, ["source", "id"], "left_anti")
            front = materialise(front.withColumn("distance", F.lit(d)), "bfs")
            if not front.limit(1).count():
                break
            seen = seen.unionByName(front)
        return seen

    def neighbours(self) -> DataFrame:
        """id, other: nodes with a common successor or predecessor, the node included."""
        e = self.edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
        ends = [(0, "src", "dst"), (1, "dst", "src")]
        rows = reduce(DataFrame.unionByName, [e.select(F.col(a).alias("id"), F.struct(F.lit(k).alias("way"), F.col(b).alias("end")).alias("token")) for k, a, b in ends])
        met = rows.groupBy("token").count().agg(F.sum(F.pow("count", F.lit(2)))).first()[0] or 0.0
        if met > rows.select("id").distinct().count() ** 2 / 4:
            return touching(code_sets(rows, "id", "token"), "id")
        return rows.join(rows.withColumnRenamed("id", "other"), "token").select("id", "other").distinct()

    def components(self) -> DataFrame:
        """id, component (smallest id)."""
        c = connected_components(self.edges.select("src", "dst"))
        joined = self.nodes.select("id").join(c, F.col("id") == F.col("node"), "left")
        return joined.select("id", F.coalesce("component", "id").alias("component"))

    def closure(self, *, most: int = 1000) -> DataFrame:
        """src, dst: every pair with a directed path, by doubling the paths."""
        paths = materialise(self.edges.select("src", "dst").distinct(), "closure")
        n = paths.count()
        for _ in range(most):
            longer = paths.select("src", F.col("dst").alias("_m")).join(paths.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst")
            paths = materialise(paths.unionByName(longer).distinct(), "closure")
            m = paths.count()
            if m == n:
                break
            n = m
        return paths

    def transitive_reduction(self) -> DataFrame:
        """Edges of an acyclic graph that no longer path replaces."""
        e = self.edges.select("src", "dst").distinct()
        via = e.select("src", F.col("dst").alias("_m")).join(self.closure().select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()
        return e.join(via, ["src", "dst"], "left_anti")

    def contract(self, ids: DataFrame, into, *, outgoing_only: bool = False) -> DataFrame:
        """Edges after ``ids`` became the node ``into``: distinct, self loops dropped, or
        with ``outgoing_only`` the published behaviour (incoming ones are lost)."""
        gone = ids.select("id").withColumn("_g", F.lit(True))
        e = self.edges.select("src", "dst").join(gone.select(F.col("id").alias("src"), F.col("_g").alias("_s")), "src", "left")
        e = e.join(gone.select(F.col("id").alias("dst"), F.col("_g").alias("_d")), "dst", "left")
        if outgoing_only:
            e = e.where(F.col("_d").isNull() | F.col("_s").isNotNull())
        put = lambda c, flag: F.when(F.col(flag), F.lit(into)).otherwise(F.col(c)).alias(c)
        out = e.select(put("src", "_s"), put("dst", "_d")).distinct()
        return out if outgoing_only else out.where("src <> dst")

    def _inside(self) -> DataFrame:
        """center, internal: the edges between the members of each group: loops at members,
        edges that touch the center, and those that close a triangle with it. Triangles are
        found as paths along edges from nodes of fewer to nodes of more neighbours, so that
        a node of many is the middle of few."""
        w = self.edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))
        w = materialise(w, "groups")
        ids = self.nodes.select("id")
        loops, links = w.where("a = b").select("a", "n"), w.where("a <> b")
        both = links.select("a", "b", "n").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
        degree = materialise(both.groupBy("a").agg(F.count("*").alias("k")), "groups")
        ranked = links.join(degree.withColumnRenamed("k", "ka"), "a").join(degree.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b")
        up = F.struct("ka", "a") < F.struct("kb", "b")
        e = materialise(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"), "n"), "groups")
        path = e.select("u", "v", F.col("n").alias("uv")).join(e.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("n").alias("vw")), "v")
        closed = path.join(e.select("u", F.col("v").alias("w"), F.col("n").alias("uw")), ["u", "w"])
        across = closed.select(F.inline(F.array(*[F.struct(F.col(c).alias("a"), F.col(m).alias("n")) for c, m in (("u", "vw"), ("v", "uw"), ("w", "uv"))])))
        near = both.join(loops.select(F.col("a").alias("b"), F.col("n").alias("l")), "b").select("a", F.col("l").alias("n"))
        every = both.select("a", "n").unionByName(loops).unionByName(near).unionByName(across)
        return every.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("internal")).join(ids, "id", "left_semi").withColumnRenamed("id", "center")

    def groups(self) -> DataFrame:
        """center, members, value, internal: each node with its neighbours."""
        near = self.both_ways().select(F.col("id").alias("center"), F.col("other").alias("id"))
        own = self.nodes.select(F.col("id").alias("center"), F.col("id"))
        member = own.unionByName(near).distinct()
        n = self._inside()
        g = member.groupBy("center").agg(F.array_sort(F.collect_set("id")).alias("members"), F.count("*").alias("value"))
        return g.join(n, "center", "left").withColumn("internal", F.coalesce("internal", F.lit(0)).cast("long"))

    def best_groups(self, rating: str = "internal") -> DataFrame:
        """Groups by rating (value, internal, or either over the group's size), one for
        each set of members."""
        rate = {"value": F.col("value"), "internal": F.col("internal"), "value_avg": F.col("value") / F.size("members"), "internal_avg": F.col("internal") / F.size("members")}
        g = self.groups().withColumn("rating", rate[rating].cast("double"))
        return g.groupBy("members", "rating").agg(F.min("center").alias("center")).select("center", "members", "rating")
