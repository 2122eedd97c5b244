"""Canonical tables over the data folder: sequences, intervals, edges, slices, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sequences(spark, sf_dir) -> DataFrame:
    """collection, version, time, ts, symbol, value, k: one row an event, versions by
    user, positions by time."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        (F.col("user_id") % 10).alias("collection"),
        F.col("user_id").alias("version"),
        (F.row_number().over(order) - 1).cast("long").alias("time"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"),
        F.col("event_type").alias("symbol"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


#: The same table in DuckDB's SQL, as the first of a query's common tables.
SEQ = """seq AS (
  SELECT user_id % 10 AS collection, user_id AS version,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS time,
         epoch_us(ts) / 1e6 AS start, event_type AS symbol, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def node_id() -> F.Column:
    return F.concat_ws(".", "version", "time")


#: Versions of a piece; pieces then grow in number with the table, not in size.
PIECE_VERSIONS = 15


def piece_edges(spark, sf_dir) -> DataFrame:
    """piece, v1, t1, v2, t2: equal symbols of a piece's versions at positions that differ
    by one at most, a pair once."""
    seq = sequences(spark, sf_dir).select(F.expr(f"version div {PIECE_VERSIONS}").alias("piece"), "version", "time", "symbol")
    a = seq.select("piece", "symbol", F.col("version").alias("v1"), F.col("time").alias("t1"), F.explode(F.array(F.col("time") - 1, F.col("time"), F.col("time") + 1)).alias("t2"))
    b = seq.select("piece", "symbol", F.col("version").alias("v2"), F.col("time").alias("t2"))
    return a.join(b, ["piece", "symbol", "t2"]).where("v1 < v2").select("piece", "v1", "t1", "v2", "t2")


def segment_edges(seq: DataFrame) -> DataFrame:
    """Multigraph edges between equal symbols at equal positions of a collection."""
    a = seq.select("collection", "time", "symbol", F.col("version").alias("v1"), F.col("k").alias("k1"))
    b = seq.select("collection", "time", "symbol", F.col("version").alias("v2"), F.col("k").alias("k2"))
    both = a.join(b, ["collection", "time", "symbol"]).where("v1 < v2")
    return both.select(
        "collection", F.concat_ws(".", "v1", "time").alias("src"), F.concat_ws(".", "v2", "time").alias("dst"), "k1", "k2"
    )


EDGES = (
    SEQ
    + """,
edges AS (
  SELECT a.collection, a.version || '.' || a.time AS src, b.version || '.' || b.time AS dst, a.k AS k1, b.k AS k2
  FROM seq a JOIN seq b ON a.collection = b.collection AND a.time = b.time AND a.symbol = b.symbol AND a.version < b.version)"""
)
