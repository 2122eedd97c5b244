"""Feature points: one segmentation of each recording, and features joined to its segments.

A list of features is a plan: each has a kind, which names its join, and rows of its own.
``feature_points`` folds them into one table, a column a feature. Every join meets by
(recording, time bucket) and is aggregated by (recording, segment) before the next one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import interval

# Names of features, the mark of their files' names, and whether they are
# segmentations.
CATALOGUE = """
sections sections segmentation
bars beats segmentation
beats beats segmentation
onsets onsets segmentation
onsets2 onsets2 segmentation
logcentroid logcentroid feature
melody melody feature
pitch pitch feature
amplitude amplitude feature
energy energy feature
intensity intensity feature
flux flux feature
skewness skewness feature
zero zero feature
tonal tonal feature
onsetfreq onsetfreq feature
keystrength keystrength feature
tuning tuning feature
tempo tempo feature
mfcc mfcc feature
chroma chroma feature
chords chords feature
johan johan feature
johan7 johan feature
flohanbeats johan segmentation
madbars madbars segmentation
madbeats madbars segmentation
madhanbars johan segmentation
silvet silvet feature
qmtrans qmtrans feature
essentiabeats essentia segmentation
essentiatuning essentia feature
essentiakey essentia feature
essentiachords freesound feature
flossentiabars essentia segmentation
flosshanbars essentia segmentation
gochords gochords feature
"""

#: name -> (mark, whether it is a segmentation)
FEATURES = {n: (m, k == "segmentation") for n, m, k in (line.split() for line in CATALOGUE.strip().splitlines())}


@dataclass(frozen=True)
class Feature:
    """A feature's column ``name``, its ``kind`` and ``rows``. Kinds:

    * ``label``: rows (key, idx, start, end, label); the label that overlaps most.
    * ``mean``: rows (key, start, duration, value), value a number or an array of numbers;
      the mean of what starts in the segment or still sounds when it begins.
    * ``pitches``: rows (key, start, duration, value); pitch classes (value modulo 12) of
      events that fill more than ``share`` of the segment, the ``most`` longest of them.
    """

    name: str
    kind: str
    rows: DataFrame
    share: float = 0.2
    most: int = 3


def feature_files(files: DataFrame, names: list[str]) -> DataFrame:
    """folder, feature, path: of each folder's json and n3 files (path) the first, by path,
    whose name has the mark of a feature; a feature without a file gives no row."""
    wanted = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(FEATURES[n][0]).alias("mark")) for n in names])
    name, folder = F.substring_index("path", "/", -1), F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    f = files.select("path", folder.alias("folder"), name.alias("name"), F.explode(wanted).alias("w"))
    return f.where(F.col("name").rlike(r"\.(json|n3)$") & F.contains("name", F.col("w.mark"))).groupBy("folder", F.col("w.feature").alias("feature")).agg(F.min("path").alias("path"))


def segments(times: DataFrame, key: str, *, doubletime: bool = False) -> DataFrame:
    """key, i, start, end of the distinct times (key, time) of each recording; the last
    segment has no end. ``doubletime`` keeps every other time. Null times are left out."""
    w = Window.partitionBy(key).orderBy("time")
    t = times.where("time IS NOT NULL").select(key, F.col("time").cast("double").alias("time")).distinct()
    t = t.withColumn("i", (F.row_number().over(w) - 1).cast("long"))
    if doubletime:
        t = t.where("i % 2 = 0").withColumn("i", F.expr("i div 2"))
    return t.select(key, "i", F.col("time").alias("start"), F.lead("time").over(w).alias("end"))


def bars_by_changes(beats: DataFrame, changes: DataFrame, key: str, *, meter: int = 4) -> DataFrame:
    """key, time of bars: every ``meter``-th beat (key, time), from the phase that most
    changes (key, time) are nearest to; without changes, from the first beat."""
    w = Window.partitionBy(key).orderBy("time")
    b = beats.where("time IS NOT NULL").select(key, "time").distinct().withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    votes = interval.meter_phase(interval.nearest(changes.where("time IS NOT NULL").select(key, "time"), b, key, "time", "n").where("n IS NOT NULL"), key, "n", meter)
    phase = F.coalesce("phase", F.lit(0))
    return b.join(votes.select(key, "phase"), key, "left").where((F.col("n") >= phase) & ((F.col("n") - phase) % meter == 0)).select(key, "time")


def closed(segs: DataFrame, key: str, last: DataFrame) -> DataFrame:
    """Segments whose open end is past everything of the recording: last (key, stop)."""
    s = segs.join(last, key, "left").withColumn("open", F.col("end").isNull())
    return s.withColumn("end", F.coalesce("end", F.greatest("start", "stop") + 1, F.col("start") + 1)).drop("stop")


def _labels(segs: DataFrame, f: Feature, key: str, width: float) -> DataFrame:
    rows = f.rows.where("start IS NOT NULL AND end IS NOT NULL")
    ends = closed(segs, key, rows.groupBy(key).agg(F.max("end").alias("stop")))
    return interval.overlap_argmax(ends, rows, key, width=width).select(key, "i", F.col("label").alias(f.name))


def _met(segs: DataFrame, f: Feature, key: str, width: float) -> DataFrame:
    rows = f.rows.where("start IS NOT NULL AND value IS NOT NULL").withColumn("duration", F.coalesce("duration", F.lit(0.0)))
    ends = closed(segs, key, rows.groupBy(key).agg(F.max(F.col("start") + F.col("duration")).alias("stop")))
    return interval.group_events(ends, rows, key, width=width)


def _means(segs: DataFrame, f: Feature, key: str, width: float, shift: bool) -> DataFrame:
    met = _met(segs, f, key, width)
    if f.rows.schema["value"].dataType.typeName() == "array":
        parts = met.select(key, "i", F.posexplode("value").alias("_c", "_v")).groupBy(key, "i", "_c").agg(F.avg("_v").alias("_m"))
        mean = parts.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct("_c", "_m"))).alias("_x")).select(key, "i", F.col("_x._m").alias(f.name))
    else:
        mean = met.groupBy(key, "i").agg(F.avg("value").alias(f.name))
    return mean.withColumn("i", F.col("i") - 1) if shift else mean


def _pitches(segs: DataFrame, f: Feature, key: str, width: float, shortest: bool) -> DataFrame:
    met = _met(segs, f, key, width)
    share = (F.least("s1", "e1") - F.greatest("s0", "e0")) / (F.col("s1") - F.col("s0"))
    kept = met.join(segs.select(key, "i", F.col("end").isNull().alias("open")), [key, "i"]).where(F.col("open") | (share > f.share))
    sums = kept.groupBy(key, "i", F.pmod(F.col("value").cast("long"), F.lit(12)).alias("pc"), "s0", "s1")
    n = sums.agg(F.min("e0").alias("e0"), F.sum(F.col("e1") - F.col("e0")).alias("sounds"))
    length = F.round(F.least(F.col("e0") + F.col("sounds"), "s1") - F.greatest("e0", "s0"), 6)
    ranked = n.groupBy(key, "i").agg(F.array_sort(F.collect_list(F.struct((length if shortest else -length).alias("o"), "pc"))).alias("x"))
    found = ranked.select(key, "i", F.array_sort(F.slice("x", 1, f.most)["pc"]).alias(f.name))
    none = F.expr("CAST(array() AS array<bigint>)")
    return segs.select(key, "i").join(found, [key, "i"], "left").withColumn(f.name, F.coalesce(f.name, none))


def feature_points(
    segs: DataFrame, features: list[Feature], key: str, *, width: float, published_shift: bool = False, published_shortest: bool = False
) -> DataFrame:
    """key, i, time and a column for each feature; segments that lack one are left out (no
    pitch at all is an empty array). ``width`` is that of the time buckets that rows meet
    in. As published, means came from the following segment (``published_shift``) and the
    shortest pitches were kept instead of the longest (``published_shortest``)."""
    out = segs.select(key, "i", F.col("start").alias("time"))
    for f in features:
        if f.kind == "label":
            column = _labels(segs, f, key, width)
        elif f.kind == "mean":
            column = _means(segs, f, key, width, published_shift)
        elif f.kind == "pitches":
            column = _pitches(segs, f, key, width, published_shortest)
        else:
            raise ValueError(f"no kind of feature: {f.kind}")
        out = out.join(column.where(F.col(f.name).isNotNull()), [key, "i"])
    return out


def vector(names: list[str]) -> Column:
    """Several numeric feature columns as one array."""
    return F.array(*[F.col(n).cast("double") for n in names])
