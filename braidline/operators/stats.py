"""Histograms, entropy, modes and medians by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def vocabulary_histogram(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, n with a zero for each value of the whole table a key lacks: the
    vocabulary is exploded beside each key, and counts are added up once."""
    words = rows.select(value).distinct().agg(F.collect_set(value).alias("_w"))
    zero = rows.select(key).distinct().join(F.broadcast(words)).select(key, F.explode("_w").alias(value), F.lit(0).alias("_n"))
    n = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    return n.unionByName(zero).groupBy(key, value).agg(F.sum("_n").alias("n"))


def frequencies(hist: DataFrame, key: str) -> DataFrame:
    return hist.withColumn("freq", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 6)).drop("n")


def entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return p.groupBy(key).agg(F.round(-F.sum(F.col("p") * F.ln("p")), 6).alias("entropy"))


def value_stats(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, sd, median, published_median: the last takes the sorted element at half the
    length, rounded half up, so odd lengths are one too high."""
    g = rows.groupBy(key).agg(F.round(F.stddev_samp(value), 6).alias("sd"), F.round(F.median(value), 6).alias("median"), F.sort_array(F.collect_list(value)).alias("_l"))
    return g.select(key, "sd", "median", F.get("_l", F.floor(F.size("_l") / 2.0 + 0.5).cast("int")).alias("published_median"))


def most_common(rows: DataFrame, keys: list[str], value: str, order: list[str], k: int) -> DataFrame:
    """The k most frequent values, ties to the one first seen last."""
    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_f"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("_f"))
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_f")


def dense_histogram(rows: DataFrame, value: str) -> DataFrame:
    """bin, n for every whole number from the least to the greatest value."""
    n = rows.groupBy(F.col(value).alias("bin")).agg(F.count("*").alias("n"))
    ends = n.agg(F.sequence(F.min("bin"), F.max("bin")).alias("b")).select(F.explode("b").alias("bin"))
    return ends.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
