"""How close each version of a collection is to the collection's consensus.

Events are read as sequences (a version a user, a position an event). Each position of a
collection has a consensus label; a version's agreement is the share of its positions that
carry it. The report gives a row a version, with its length, agreement, the entropy of its
labels, its most frequent label, and its place in the collection (ties share one), partitioned by collection.
Only the collections asked for are replaced, so a rerun writes the same rows and a partial
run leaves the others as they are.

    python -m jobs.version_report --config jobs/version_report.json --tables <folder> --out <folder>
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidline.operators import sequence, stats
from braidline.sources.views import sequences
from jobs import settings

log = logging.getLogger("version_report")
SCHEMA = "version long, positions long, agreement double, entropy double, label string, place long, collection long"
FLAGS = {"tables": "folder with events.parquet", "out": "folder of the output", "collections": "comma-separated collections to replace (default: all)"}


def versions(seq: DataFrame) -> DataFrame:
    """A row a version of ``seq`` (collection, version, time, symbol)."""
    consensus = sequence.mode_labels(seq, ["collection", "time"]).select("collection", "time", F.col("label").alias("consensus"))
    agrees = seq.join(consensus, ["collection", "time"]).groupBy("collection", "version").agg(
        F.count("*").alias("positions"), F.round(F.avg((F.col("symbol") == F.col("consensus")).cast("int")), 6).alias("agreement")
    )
    label = sequence.mode_labels(seq, ["version"], order="time").select("version", "label")
    found = agrees.join(stats.entropy(seq, "version", "symbol"), "version").join(label, "version")
    # a collection has at most a million and one agreements, whatever its versions number
    alike = found.groupBy("collection", "agreement").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("collection").orderBy(F.desc("agreement"))) - F.col("n")
    places = alike.select("collection", "agreement", (ahead + 1).alias("place"))
    return found.join(places, ["collection", "agreement"]).select("version", "positions", "agreement", "entropy", "label", "place", "collection")


def report(spark: SparkSession, tables: str, out: str, collections: str | None = None) -> DataFrame:
    """Write the report of the versions of all or some collections; returns the output."""
    seq = sequences(spark, tables)
    if collections:
        seq = seq.where(F.col("collection").isin([int(c) for c in str(collections).split(",")]))
    found = versions(seq)
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(out)
    written = spark.read.schema(SCHEMA).parquet(out)
    log.info("read events of %s, %s; wrote a report of %d versions to %s", tables, f"collections {collections}" if collections else "all collections", written.count(), out)
    return written


if __name__ == "__main__":
    settings.main(report, FLAGS)
