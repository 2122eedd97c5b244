"""Encoding and window operators over positioned sequences (version, time, symbol)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen_codes(seq: DataFrame, keys: list[str], order: list[str], *, per: list[str] | None = None) -> DataFrame:
    """keys, code: dictionary codes in order of first appearance."""
    per = per or []
    first = seq.groupBy(*per, *keys).agg(F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*per).orderBy("_first") if per else Window.orderBy("_first")
    return first.withColumn("code", (F.row_number().over(w) - 1).cast("long")).drop("_first")


def encode(seq: DataFrame, keys: list[str], order: list[str], **kw) -> DataFrame:
    """Sequences with their code; the dictionary is joined back by its keys."""
    return seq.join(first_seen_codes(seq, keys, order, **kw), [*(kw.get("per") or []), *keys])


def durations(seq: DataFrame, start: str = "start", last: float = 1.0) -> DataFrame:
    w = Window.partitionBy("version").orderBy("time")
    return seq.withColumn("duration", F.coalesce(F.lead(start).over(w) - F.col(start), F.lit(last)))


def run_starts(seq: DataFrame, value: str = "symbol") -> DataFrame:
    """Rows whose value differs from the one before."""
    w = Window.partitionBy("version").orderBy("time")
    return seq.withColumn("_before", F.lag(F.struct(value)).over(w)).where(~F.col("_before").eqNullSafe(F.struct(value))).drop("_before")


def kth_positions(seq: DataFrame, *, descending: bool = False) -> DataFrame:
    """Rank of every row from its version's start or end; 1 is the first or last."""
    by = F.desc("time") if descending else F.col("time")
    return seq.withColumn("rank", F.row_number().over(Window.partitionBy("version").orderBy(by)))


def mode_labels(seq: DataFrame, by: list[str], value: str = "symbol", order: str = "version") -> DataFrame:
    """by, label, support, slice_size: the most frequent value, ties to the one that is
    first seen last."""
    n = seq.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return n.groupBy(*by).agg(
        F.max_by(value, F.struct("n", "seen", value)).alias("label"), F.max("n").alias("support"), F.sum("n").alias("slice_size")
    )


def mode_of(value: str, n: str) -> Column:
    """An aggregate: the value of the largest count, ties to the smallest value."""
    return F.min(F.struct((-F.col(n)).alias("n"), F.col(value).alias("value")))["value"]


def fill_gaps(values: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """Missing numbers between two known ones on the line between them; leading ones 0,
    trailing ones one more each."""
    w = Window.partitionBy(*key).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(order))
    d = values.withColumns(
        {
            "_lo": F.last(value, ignorenulls=True).over(before), "_lo_at": F.last(known, ignorenulls=True).over(before),
            "_hi": F.first(value, ignorenulls=True).over(after), "_hi_at": F.first(known, ignorenulls=True).over(after),
        }
    )
    line = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col(order) - F.col("_lo_at")) / (F.col("_hi_at") - F.col("_lo_at"))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(F.col("_lo").isNull(), F.lit(0.0))
        .when(F.col("_hi").isNull(), F.col("_lo") + (F.col(order) - F.col("_lo_at")))
        .otherwise(line)
    )
    return d.withColumn(value, filled).drop("_lo", "_lo_at", "_hi", "_hi_at")


def frame_changes(frames: DataFrame, key: str, value: str, *, hop: int = 2048, rate: int = 44100) -> DataFrame:
    """Framewise labels as intervals: one row a run, from its start to the next one's."""
    w = Window.partitionBy(key).orderBy("frame")
    runs = frames.withColumn("_b", F.lag(F.struct(value)).over(w)).where(~F.col("_b").eqNullSafe(F.struct(value)))
    start = F.col("frame") * hop / rate
    return runs.select(key, value, start.alias("start"), F.lead(start).over(w).alias("end"))


def normal_form(points: str | Column, dims: int) -> Column:
    """Points (arrays) in order, their first component from the first point's."""
    p = F.array_sort(F.col(points) if isinstance(points, str) else points)
    zero = F.get(F.get(p, 0), 0)
    return F.transform(p, lambda x: F.concat(F.array(x[0] - zero), F.slice(x, 2, dims)))


def parallel_only(vectors: Column) -> Column:
    """Vectors that are zero but for at most one dimension."""
    return F.filter(vectors, lambda v: F.size(F.filter(v, lambda x: x != 0)) <= 1)
