"""Queries over set helpers, grids, hierarchies and painted patterns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arrays, hierarchy, interval
from ..sources.views import SEQ, sequences, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ORDERS = "o AS (SELECT l_orderkey AS k, list(l_suppkey % 6 ORDER BY l_suppkey % 6) AS a, list(l_partkey % 6 ORDER BY l_partkey % 6) AS b FROM lineitem GROUP BY 1)"


def _order_sets(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"))
    return g.agg(F.sort_array(F.collect_list(F.col("l_suppkey") % 6)).alias("a"), F.sort_array(F.collect_list(F.col("l_partkey") % 6)).alias("b"))


@query(f"""WITH {_ORDERS}, d AS (SELECT k, a, b, list_distinct(a) AS da, list_distinct(b) AS db FROM o)
SELECT k, len(list_filter(da, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(db, lambda x: NOT list_contains(a, x))) = 0 AS equal,
 len(list_filter(da, lambda x: NOT list_contains(b, x))) = 0 AND len(da) < len(db) AS subset,
 coalesce(list_sum([least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))) FOR x IN da]), 0)::INTEGER AS common FROM d""")
def set_relations(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _order_sets(spark, sf_dir).select("k", arrays.equal_sets(a, b).alias("equal"), arrays.proper_subset(a, b).alias("subset"), arrays.multiset_common(a, b).alias("common"))


@query("""WITH p AS (SELECT p_partkey, p_size FROM part) SELECT p_partkey, CAST(CASE WHEN p_size <= 6 THEN 0 WHEN p_size <= 15 THEN 1 WHEN p_size <= 30 THEN 2 ELSE 3 END AS INTEGER) AS place FROM p""")
def closest_index(spark, sf_dir):
    grid = F.array(*map(F.lit, [2, 10, 20, 40]))
    return table(spark, sf_dir, "part").select("p_partkey", arrays.closest_index(grid, F.col("p_size")).alias("place"))


@query(f"""WITH {SEQ}, b AS (SELECT version, time, symbol, lag(symbol) OVER (PARTITION BY version ORDER BY time) AS b FROM seq), s AS (SELECT version, symbol, time AS start, coalesce(lead(time) OVER (PARTITION BY version ORDER BY time) - time, 1) AS length FROM b WHERE b IS DISTINCT FROM symbol),
n AS (SELECT version, symbol, length, count(*) AS n, min(start) AS seen FROM s GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY version, symbol ORDER BY n DESC, seen DESC) AS r FROM n)
SELECT version, symbol, length FROM m WHERE r = 1""")
def modal_lengths(spark, sf_dir):
    from ..operators import sequence

    w = Window.partitionBy("version").orderBy("time")
    s = sequence.run_starts(sequences(spark, sf_dir)).withColumn("length", F.coalesce(F.lead("time").over(w) - F.col("time"), F.lit(1)))
    s = s.select(F.concat_ws("|", "version", "symbol").alias("key"), "version", "symbol", F.col("time").alias("start"), "length")
    return arrays.same_length(s, "key").select("version", "symbol", "length").distinct()


@query(f"""WITH {SEQ}, p AS (SELECT version, k // 10 AS slice, min(time) AS time FROM seq GROUP BY ALL) SELECT a.slice AS i, b.slice AS j, sum(sign(b.time - a.time))::BIGINT AS votes FROM p a JOIN p b ON a.version = b.version AND a.slice <> b.slice GROUP BY ALL""")
def time_votes(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    return arrays.time_votes(seq.select("version", "time", F.floor(F.col("k") / 10).alias("slice")))


@query(f"""WITH {SEQ}, o AS (SELECT version, time AS start, 1 + k % 3 AS length, k // 20 AS type FROM seq WHERE symbol = 'signup') SELECT o.version, t.time, max(type) AS type FROM o, LATERAL (SELECT unnest(range(start, start + length)) AS time) t GROUP BY ALL""")
def painted_patterns(spark, sf_dir):
    o = sequences(spark, sf_dir).where("symbol = 'signup'")
    return arrays.painted(o.select("version", F.col("time").alias("start"), (1 + F.col("k") % 3).alias("length"), F.floor(F.col("k") / 20).cast("int").alias("type")))


@query("""WITH n AS (SELECT n_regionkey, c_nationkey, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT n_regionkey, avg(v) AS v FROM n GROUP BY 1)
SELECT 'n' || c_nationkey AS id, round(v, 4) AS value FROM n UNION ALL SELECT 'r' || n_regionkey, round(v, 4) FROM r UNION ALL SELECT 'world', round(avg(v), 4) FROM r""")
def hierarchy_averages(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    leaf = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_acctbal").alias("value"))
    used = leaf.select("parent").distinct()
    nations = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child")).join(used.withColumnRenamed("parent", "child"), "child", "left_semi")
    regions = nations.select(F.lit("world").alias("parent"), F.col("parent").alias("child")).distinct()
    parts = leaf.select("parent", F.col("id").alias("child")).unionByName(nations).unionByName(regions)
    return hierarchy.averages(parts, leaf).where("id NOT LIKE 'c%'").withColumn("value", F.round("value", 4))


@query(f"""WITH {SEQ}, c AS (SELECT time % 10 AS i, k // 10 AS j, version % 3 AS g, count(*) AS v FROM seq GROUP BY ALL) SELECT i, j, round(product(v), 3) AS v FROM c GROUP BY ALL""")
def cell_products(spark, sf_dir):
    c = sequences(spark, sf_dir).groupBy((F.col("time") % 10).alias("i"), F.floor(F.col("k") / 10).alias("j"), (F.col("version") % 3).alias("g")).agg(F.count("*").cast("double").alias("v"))
    return arrays.cell_products(c, 3).withColumn("v", F.round("v", 3))


@query()
def fitted_grids(spark, sf_dir):
    """Offset and unit (days) of the regular grid nearest to each version's purchases."""
    import pandas as pd

    seq = sequences(spark, sf_dir).where("symbol = 'purchase'")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        offset, unit = interval.fit_grid(((pdf.start - pdf.start.min()) / 86400).tolist())
        return pd.DataFrame([(pdf.version.iloc[0], round(offset, 4), round(unit, 4))], columns=["version", "offset", "unit"])

    # few bytes, long searches: spread by number of cores, not by bytes
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return seq.select("version", "start").repartition(tasks, "version").groupBy("version").applyInPandas(run, "version long, offset double, unit double")


@query()
def pattern_parts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    o = li.select((F.col("l_orderkey") % 10).alias("song"), (F.col("l_partkey") % 8).alias("pattern"), F.col("l_orderkey").alias("occ"), F.col("l_linenumber").alias("point"))
    return hierarchy.pattern_parts(o.distinct())


@query(f"""WITH {SEQ}, p AS (SELECT collection, k // 10 AS slice, version, min(time) AS time FROM seq GROUP BY ALL), m AS (SELECT *, max(time) OVER (PARTITION BY collection, version ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p),
o AS (SELECT * FROM m WHERE b IS NULL OR b <= time), n AS (SELECT *, count(*) OVER (PARTITION BY collection, slice) AS c FROM o), s AS (SELECT * FROM n WHERE c >= 2)
SELECT collection, version, time, dense_rank() OVER (PARTITION BY collection ORDER BY slice) - 1 AS slice FROM s""")
def valid_slices(spark, sf_dir):
    from ..operators import partition

    p = sequences(spark, sf_dir).select("collection", "version", "time", F.floor(F.col("k") / 10).cast("long").alias("slice"))
    return partition.ensure_valid(p, ["collection"]).select("collection", "version", "time", "slice")


@query("""WITH p AS (SELECT p_partkey, ['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B'][p_partkey % 12 + 1] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'm' END AS label FROM part)
SELECT p_partkey, label, list_sort([CAST((x + p_partkey % 12) % 12 AS INTEGER) FOR x IN CASE WHEN p_partkey % 2 = 0 THEN [0, 4, 7] ELSE [0, 3, 7] END]) AS pcs FROM p""")
def label_pcsets(spark, sf_dir):
    from ..functions import theory

    p = table(spark, sf_dir, "part")
    label = F.concat(theory.pitch_name("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("m"))
    p = p.select("p_partkey", label.alias("label"))
    return p.withColumn("pcs", theory.label_to_pc_set("label"))


@query()
def version_pairs(spark, sf_dir):
    from ..operators import align

    return align.disjoint_pairs(sequences(spark, sf_dir).select("collection", "version").distinct(), "collection")


@query(f"""WITH {SEQ}, g AS (SELECT symbol, lead(symbol) OVER (PARTITION BY version ORDER BY time) AS next FROM seq) SELECT symbol, next, count(*) AS n FROM g WHERE next IS NOT NULL GROUP BY ALL ORDER BY n DESC, symbol, next LIMIT 8""")
def commonest_transitions(spark, sf_dir):
    w = Window.partitionBy("version").orderBy("time")
    g = sequences(spark, sf_dir).withColumn("next", F.lead("symbol").over(w)).where("next IS NOT NULL")
    return g.groupBy("symbol", "next").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "symbol", "next").limit(8)
