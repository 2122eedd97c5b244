"""Labels of conversation turns by position, kept up to date as conversations arrive.

A conversation is one version of a dialogue, its turns are positions, and a turn's label is
its role with the form of its text. The job keeps, for every position, how many turns have
each label, its share, and which label is the position's consensus.

Files that have arrived since the last run are read once, as a stream that ends when there
are no more (its checkpoint names the files taken). Every micro-batch adds up its own turns
and writes the sums to a folder that bears its number, so a batch that runs again after a
failure replaces what it had written. The output is the sum over all batches, written anew
by role; a rerun without new files writes the same rows.

    python -m jobs.turn_slices --config jobs/turn_slices.json --source <folder> --out <folder>
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.operators.sequence import mode_of
from jobs import settings

log = logging.getLogger("turn_slices")
SCHEMA = "conv_id long, turn long, role string, text string"
PARTIAL = "slice long, role string, label string, n long, n_words long"
#: From so many words on a text is long.
LONG_WORDS = 40
FLAGS = {"source": "folder, file or pattern of conversations (Parquet)", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint and the batches' sums", "files_per_batch": "most files a micro-batch takes"}


def pattern(path: str) -> str:
    """A path as a pattern that only it matches: file streams take a folder or a pattern,
    and as a pattern a single file will do too."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def word_count(text: str | Column) -> Column:
    """Words between white space; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def labelled(turns: DataFrame) -> DataFrame:
    """slice, role, label, n_words of every turn."""
    asks = F.coalesce(F.rtrim("text").endswith("?"), F.lit(False))
    n = F.col("n_words")
    form = F.when(n == 0, "empty").when(asks, "question").when(n >= LONG_WORDS, "long").otherwise("short")
    role = F.coalesce("role", F.lit("unknown"))
    return turns.withColumn("n_words", word_count("text")).select(F.col("turn").alias("slice"), role.alias("role"), F.concat_ws("/", role, form).alias("label"), "n_words")


def fold(turns: DataFrame, batch: int, sums: str) -> None:
    """A batch's sums, to the folder of its number."""
    partial = labelled(turns).groupBy("slice", "role", "label").agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"))
    partial.write.mode("overwrite").parquet(f"{sums}/batch={batch}")


def slices(partial: DataFrame) -> DataFrame:
    """The sums of all batches, with each label's share of its slice and the consensus."""
    total = partial.groupBy("slice", "role", "label").agg(F.sum("n").alias("n"), F.sum("n_words").alias("n_words"))
    per_slice = total.groupBy("slice").agg(F.sum("n").alias("size"), mode_of("label", "n").alias("consensus"))
    share = F.round(F.col("n") / F.col("size"), 6)
    found = total.withColumnRenamed("slice", "_slice").join(per_slice, F.col("_slice").eqNullSafe(F.col("slice")))
    return found.select("slice", "label", "n", "n_words", share.alias("share"), (F.col("label") == F.col("consensus")).alias("is_consensus"), "role")


def update(spark: SparkSession, source: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> DataFrame:
    """Take new conversations and bring the slices up to date; returns the output."""
    sums = f"{checkpoint.rstrip('/')}/sums"
    # so that there is something to add up where nothing has arrived yet
    spark.createDataFrame([], PARTIAL).write.mode("overwrite").parquet(f"{sums}/batch=-1")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", int(files_per_batch)).parquet(pattern(source))
    query = stream.writeStream.foreachBatch(lambda df, batch: fold(df, batch, sums)).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new turns from %s in %d batches", sum(p.numInputRows for p in query.recentProgress), source, len(query.recentProgress))
    slices(spark.read.schema(PARTIAL).parquet(sums)).write.mode("overwrite").partitionBy("role").parquet(out)
    written = spark.read.schema("slice long, label string, n long, n_words long, share double, is_consensus boolean, role string").parquet(out)
    log.info("wrote %d rows to %s", written.count(), out)
    return written


if __name__ == "__main__":
    settings.main(update, FLAGS)
