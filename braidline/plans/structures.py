"""Queries over sections: levels of mutual best links, types of labels, alignments of a
collection's labels with themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import levels, sequence
from ..sources.views import SEQ, sequences

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The commonest symbol of each place of a collection's versions.
_LABELS = SEQ + """, n AS (SELECT collection, time, symbol, count(*) AS n, min(version) AS seen FROM seq GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY collection, time ORDER BY n DESC, seen DESC, symbol DESC) AS r FROM n),
lab AS (SELECT collection, time AS slice, symbol AS label FROM r WHERE r = 1)"""


def place_labels(spark, sf_dir):
    found = sequence.mode_labels(sequences(spark, sf_dir), ["collection", "time"])
    return found.select("collection", F.col("time").cast("long").alias("slice"), "label")


@query(f"""WITH {_LABELS}, f AS (SELECT collection, label, row_number() OVER (PARTITION BY collection ORDER BY min(slice), label) - 1 AS type FROM lab GROUP BY collection, label)
SELECT collection, slice, label, type, row_number() OVER (PARTITION BY collection, type ORDER BY slice) - 1 AS occurrence FROM lab JOIN f USING (collection, label)""")
def structure_by_types(spark, sf_dir):
    return levels.structure_by_types(place_labels(spark, sf_dir), ["collection"])


@query(f"""WITH {_LABELS}, c AS (SELECT a.collection, b.slice - a.slice AS lag, a.slice AS start FROM lab a JOIN lab b ON a.collection = b.collection AND a.label = b.label AND b.slice > a.slice),
g AS (SELECT *, CASE WHEN start - lag(start) OVER w <= 2 THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY collection, lag ORDER BY start)),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY collection, lag ORDER BY start) AS run FROM g)
SELECT collection, lag, min(start) AS start, max(start) AS stop, count(*) AS matches FROM u GROUP BY collection, lag, run HAVING max(start) - min(start) + 1 >= 8""")
def alignment_segments(spark, sf_dir):
    return levels.alignment_segments(place_labels(spark, sf_dir), ["collection"], gap=1)


@query()
def structure_by_alignment(spark, sf_dir):
    return levels.structure_by_alignment(place_labels(spark, sf_dir), ["collection"], gap=1)


@query()
def segmentation_levels(spark, sf_dir):
    """Slices of ten values of k; two are as near as the symbols that a version has in both."""
    seq = sequences(spark, sf_dir).where("k IS NOT NULL").withColumn("slice", F.floor(F.col("k") / 10).cast("long"))
    n = seq.groupBy("collection", "version", "symbol", "slice").count()
    one, other = (n.select("collection", "version", "symbol", F.col("slice").alias(s), F.col("count").alias(f"n_{s}")) for s in ("i", "j"))
    both = one.join(other, ["collection", "version", "symbol"]).where("i <> j")
    matrix = both.groupBy("collection", "i", "j").agg(F.sum(F.least("n_i", "n_j")).alias("n"))
    return levels.segmentation_levels(matrix, seq.select("collection", "slice").distinct(), ["collection"])
