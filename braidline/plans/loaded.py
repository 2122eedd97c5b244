"""Queries over feature points: features of several kinds joined to segmentations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features
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


#: Beats are the times of errors; bars are every fourth beat, from the phase that the other
#: events are nearest to.
_POINTS = SEQ + """,
ev AS (SELECT version, time AS idx, symbol AS label, value, k, start AS l0, coalesce(lead(start) OVER (PARTITION BY version ORDER BY time) - start, 0) AS dur, lead(start) OVER (PARTITION BY version ORDER BY time) AS l1 FROM seq),
bt AS (SELECT version, start AS t, row_number() OVER (PARTITION BY version ORDER BY start) - 1 AS n FROM (SELECT DISTINCT version, start FROM seq WHERE symbol = 'error')),
sn AS (SELECT version, n, row_number() OVER (PARTITION BY version, time ORDER BY abs(t - start), n) AS r FROM (SELECT DISTINCT version, start, start AS time FROM seq WHERE symbol <> 'error') JOIN bt USING (version)),
vo AS (SELECT version, n % 4 AS phase, row_number() OVER (PARTITION BY version ORDER BY count(*) DESC, n % 4) AS r FROM sn WHERE r = 1 GROUP BY version, n % 4),
tm AS (SELECT 'beats' AS segmentation, version, t FROM bt UNION ALL
 SELECT 'bars', version, t FROM bt LEFT JOIN (SELECT version, phase FROM vo WHERE r = 1) USING (version) WHERE n >= coalesce(phase, 0) AND (n - coalesce(phase, 0)) % 4 = 0),
sg AS (SELECT segmentation, version, row_number() OVER w - 1 AS i, t AS s0, lead(t) OVER w AS s1 FROM tm WINDOW w AS (PARTITION BY segmentation, version ORDER BY t)),
o AS (SELECT segmentation, version, i, label, row_number() OVER (PARTITION BY segmentation, version, i ORDER BY least(coalesce(s1, 'inf'::DOUBLE), l1) - greatest(s0, l0) DESC, idx) AS r
 FROM sg JOIN ev USING (version) WHERE l0 < coalesce(s1, 'inf'::DOUBLE) AND l1 > s0),
lb AS (SELECT segmentation, version, i, coalesce(o.label, (SELECT e.label FROM ev e WHERE e.version = sg.version AND e.l1 IS NOT NULL AND e.l0 <= sg.s0 ORDER BY e.l0 DESC LIMIT 1), (SELECT e.label FROM ev e WHERE e.version = sg.version AND e.l1 IS NOT NULL ORDER BY e.l0, e.idx LIMIT 1)) AS label
 FROM sg LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (segmentation, version, i)),
me AS (SELECT segmentation, version, i, s0, s1, value, k, l0, l0 + dur AS e1 FROM sg JOIN ev USING (version) WHERE (l0 >= s0 AND l0 < coalesce(s1, 'inf'::DOUBLE)) OR (l0 < s0 AND s0 <= l0 + dur)),
mn AS (SELECT segmentation, version, i, avg(value) AS mean FROM me WHERE value IS NOT NULL GROUP BY ALL),
pc AS (SELECT segmentation, version, i, s0, s1, k % 12 AS pc, min(l0) AS e0, sum(e1 - l0) AS sounds FROM me WHERE k IS NOT NULL AND (s1 IS NULL OR (least(s1, e1) - greatest(s0, l0)) / (s1 - s0) > 0.2) GROUP BY ALL),
px AS (SELECT *, row_number() OVER (PARTITION BY segmentation, version, i ORDER BY round(least(e0 + sounds, coalesce(s1, 'inf'::DOUBLE)) - greatest(e0, s0), 6) DESC, pc) AS r FROM pc),
pl AS (SELECT segmentation, version, i, list(pc::BIGINT ORDER BY pc) AS pitches FROM px WHERE r <= 3 GROUP BY ALL)"""


@query(f"""WITH {_POINTS} SELECT segmentation, version, i, round(s0, 3) AS time, label, round(mean, 6) AS mean, coalesce(pitches, CAST([] AS BIGINT[])) AS pitches
FROM sg JOIN lb USING (segmentation, version, i) JOIN mn USING (segmentation, version, i) LEFT JOIN pl USING (segmentation, version, i) WHERE label IS NOT NULL""")
def feature_points(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    w = Window.partitionBy("version").orderBy("time")
    ev = seq.withColumn("end", F.lead("start").over(w)).withColumn("duration", F.coalesce(F.col("end") - F.col("start"), F.lit(0.0)))
    plan = [
        features.Feature("label", "label", ev.select("version", F.col("time").alias("idx"), "start", "end", F.col("symbol").alias("label"))),
        features.Feature("mean", "mean", ev.select("version", "start", "duration", "value")),
        features.Feature("pitches", "pitches", ev.select("version", "start", "duration", F.col("k").alias("value"))),
    ]
    beats = seq.where("symbol = 'error'").select("version", F.col("start").alias("time"))
    changes = seq.where("symbol <> 'error'").select("version", F.col("start").alias("time")).distinct()
    out = None
    for name, times in (("beats", beats), ("bars", features.bars_by_changes(beats, changes, "version"))):
        p = features.feature_points(features.segments(times, "version"), plan, "version", width=86400.0)
        p = p.select(F.lit(name).alias("segmentation"), "version", "i", F.round("time", 3).alias("time"), "label", F.round("mean", 6).alias("mean"), "pitches")
        out = p if out is None else out.unionByName(p)
    return out
