"""Exact deduplication by a tree-merge of sorted digest runs, native Spark only.

Every task's rows are one slot. A run is an array of entries, sorted by digest: one entry
per text of a slot, with digest, byte length and a second 64-bit hash (these two verify
the digest), the smallest id and the number of rows. Runs are cut at fixed digests into
ranges, so that no run outgrows its task: their number follows the table's rows.

Slots exchange runs in binomial rounds: a round brings together the runs of a range whose
slot numbers agree but for their lowest ``step`` bits. ``sort_array`` merges them (its
sort finds the runs that its input consists of and merges these), and of equal entries,
now neighbours and at most one a run, the first stays with the smallest identifier and
the summed count. After the last round one run a range spans all slots, and the ranges
follow one another in digest order.

The way back uses the first runs: their entries (at most one a slot and text) meet the
final ones, and rows then meet their own slot's entry. So a text that a third of all rows
share is combined in each task on the way down, and spread over all slots on the way back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise

#: What identifies a text in a run: the digest, and what verifies it.
ENTRY = ["digest", "n_bytes", "check"]


def normalised(text_col: str) -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE_CLASS, " ")


def merged(runs: Column, most: int) -> Column:
    """One sorted run from an array of at most ``most`` sorted runs."""
    every = F.sort_array(F.flatten(runs))

    def same(a: Column, b: Column) -> Column:
        return (a["digest"] == b["digest"]) & (a["n_bytes"] == b["n_bytes"]) & (a["check"] == b["check"])

    def entry(run: Column):
        def at(x: Column, i: Column) -> Column:
            behind = [F.get(run, i + j) for j in range(1, most)]
            alike = [same(x, y) for y in behind]
            least = F.least(x["keep_id"], *[F.when(a, y["keep_id"]) for a, y in zip(alike, behind)]) if behind else x["keep_id"]
            n = sum((F.when(a, y["n"]).otherwise(0) for a, y in zip(alike, behind)), x["n"])
            first = (i == 0) | ~same(x, F.get(run, i - 1))
            return F.when(first, F.struct(*[x[c].alias(c) for c in ENTRY], least.alias("keep_id"), n.alias("n")))

        return at

    # bound once: a lambda's variable, as the sort must not run once an entry
    return F.filter(F.flatten(F.transform(F.array(every), lambda run: F.transform(run, entry(run)))), lambda x: x.isNotNull())


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, step: int = 2, run_rows: int = 8192) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. A row with a null id is never the one that stays
    unless no row of its group has an id; then keep_id is null and kept false. Rows
    repeated with the smallest id are all kept. An empty table gives no rows; other
    columns of ``docs`` are ignored."""
    text = normalised(text_col)
    slot = F.pmod(F.spark_partition_id(), F.lit(1 << bits))
    base = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"), slot.alias("slot"))
    base = materialise(base, "exact-dedup")
    final, first = tree_merge(base, bits=bits, step=step, run_rows=run_rows)
    entries = lambda runs, *keys: runs.select(*keys, F.explode("run").alias("e"))
    theirs = entries(first, "slot").select("slot", *[f"e.{c}" for c in ENTRY])
    verdict = theirs.join(entries(final).select(*[f"e.{c}" for c in ENTRY], "e.keep_id", F.col("e.n").alias("group_size")), ENTRY)
    return base.join(verdict, ["slot", *ENTRY]).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def tree_merge(base: DataFrame, *, bits: int, step: int, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """The final runs (a row a range) and the first ones (a row a slot and range) of
    ``base``: _id, slot and ENTRY."""
    ranges = max(1, -(-base.count() // run_rows))
    # the digest's first 32 bits, of which each range has an equal share
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    part = F.floor(head * ranges / (1 << 32)).cast("int")
    own = base.groupBy("slot", *ENTRY).agg(F.min("_id").alias("keep_id"), F.count("*").alias("n")).withColumn("range", part)
    first = own.groupBy("range", "slot").agg(F.sort_array(F.collect_list(F.struct(*ENTRY, "keep_id", "n"))).alias("run"))
    first = materialise(first, "exact-dedup-runs")
    runs = first
    for done in range(0, bits, step):
        take = min(step, bits - done)
        runs = runs.groupBy("range", F.shiftright("slot", take).alias("slot")).agg(merged(F.collect_list("run"), 1 << take).alias("run"))
    return runs, first


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       coalesce(doc_id = min(doc_id) OVER w, false) AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
