"""Documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and gives
the columns of ``documents`` again, but for the last, which gives packed pieces. Stages
decide by row: rows that share a doc_id, or have none, are documents of their own. Columns
of any name pass through. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidline.llm import exact_dedup, jaccard, language, packing, toxicity
from braidline.llm.common import materialise, table

#: A text counts as none of the languages below this share of its words' marginals.
LEAST_LANGUAGE_SHARE = 0.3


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many marks as it takes to clash with no column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with a number a row, written, so that the numbers last whatever happens to
    executors."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")


def _order(row: str):
    """What orders rows by doc_id, those without one last, ties by row number."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))


def _without(rows: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """``rows`` but those whose number is in ``gone``. Only rows whose slot (of 2 ** 20) is
    one of ``gone`` are exchanged, with their texts; the others stay in their tasks."""
    slot = _fresh(rows, "_slot")
    slots = F.broadcast(jaccard.slots_of(gone, row).withColumnRenamed("slot", slot))
    slotted = rows.withColumn(slot, jaccard.slot_of(row))
    alone = slotted.join(slots, slot, "left_anti").drop(slot)
    checked = slotted.join(slots, slot, "left_semi").drop(slot)
    return alone.unionByName(checked.join(gone.hint("merge"), row, "left_anti"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored toxic (0.5 and more) go; fitted on the labelled rows of ``docs``. Null
    and empty texts score as the machine's bias, and stay unless most labels are toxic;
    repeated rows fare alike, and long texts are scored whole."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null and empty ones too), or of no one language, go;
    repeated rows fare alike, and long texts are labelled whole."""
    model, name = language.train(docs, F.lit(True)), _fresh(docs, "_found")
    found = docs.withColumn(name, language.predict(model, F.col("text")))
    kept = (F.col(f"{name}.lang_pred") != language.UNKNOWN) & (F.col(f"{name}.score") >= LEAST_LANGUAGE_SHARE)
    return found.where(kept).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal but for white space, that with the smallest id stays
    (one without an id if none has one; of several with that id, one). Null texts count as
    empty, so one row stands for all empty ones."""
    row = _fresh(docs, "_row")
    rows = _numbered(docs, row)
    found = exact_dedup.exact_dedup(rows.select(_order(row).alias("key"), "text"), id_col="key")
    gone = materialise(found.where("NOT kept").select(F.col("key.row").alias(row)), "pipeline-gone")
    return _without(rows, gone, row).drop(row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, 0.8), the row with the
    smallest id stays, chosen as among copies. Rows without words are near to nothing and
    stay."""
    row = _fresh(docs, "_row")
    rows = _numbered(docs, row)
    found = materialise(jaccard.jaccard_components(rows.select(row, "text"), id_col=row), "pipeline-components")
    stay = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(F.min(_order(row)).alias("key"))
    gone = materialise(found.select(row).join(stay.select(F.col("key.row").alias(row)), row, "left_anti"), "pipeline-gone")
    return _without(rows, gone, row).drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. Null and empty texts are one end token;
    rows that share an id each give their own pieces; long texts are cut, never dropped."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: No SQL for fitted models and tokenizers; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
