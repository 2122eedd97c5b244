"""Queries over sequences, pitch classes and intervals, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import theory
from ..operators import interval, sequence, stats
from ..sources.views import SEQ, sequences, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {SEQ},
n AS (SELECT time, symbol, count(*) AS n, min(version) AS seen FROM seq GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY time) AS total, row_number() OVER (PARTITION BY time ORDER BY n DESC, seen DESC, symbol DESC) AS r FROM n)
SELECT time, symbol AS label, n AS support, total::BIGINT AS slice_size FROM r WHERE r = 1""")
def slice_mode_labels(spark, sf_dir):
    return sequence.mode_labels(sequences(spark, sf_dir), ["time"])


@query(f"""WITH {SEQ}, f AS (SELECT collection, symbol, min(version * 1000000 + time) AS f FROM seq GROUP BY ALL),
c AS (SELECT collection, symbol, row_number() OVER (PARTITION BY collection ORDER BY f) - 1 AS code FROM f)
SELECT collection, version, time, symbol, code FROM seq JOIN c USING (collection, symbol)""")
def seq_encode_first_seen(spark, sf_dir):
    out = sequence.encode(sequences(spark, sf_dir), ["symbol"], ["version", "time"], per=["collection"])
    return out.select("collection", "version", "time", "symbol", "code")


@query(f"""WITH {SEQ} SELECT version, time, coalesce(round(lead(start) OVER (PARTITION BY version ORDER BY time) - start, 3), 1.0) AS duration FROM seq""")
def seq_durations(spark, sf_dir):
    return sequence.durations(sequences(spark, sf_dir)).select("version", "time", F.round("duration", 3).alias("duration"))


@query(f"""WITH {SEQ}, b AS (SELECT *, lag(symbol) OVER (PARTITION BY version ORDER BY time) AS b FROM seq)
SELECT version, time, symbol FROM b WHERE b IS DISTINCT FROM symbol""")
def seq_run_starts(spark, sf_dir):
    return sequence.run_starts(sequences(spark, sf_dir)).select("version", "time", "symbol")


@query(f"""WITH {SEQ} SELECT version, min(time) AS first_time, max(time) AS last_time, arg_min(symbol, time) AS first_symbol, arg_max(symbol, time) AS last_symbol FROM seq GROUP BY version""")
def version_first_last(spark, sf_dir):
    return sequences(spark, sf_dir).groupBy("version").agg(
        F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min_by("symbol", "time").alias("first_symbol"), F.max_by("symbol", "time").alias("last_symbol")
    )


@query(f"""WITH {SEQ}, r AS (SELECT version, time, symbol, row_number() OVER (PARTITION BY version, symbol ORDER BY time) AS rank FROM seq) SELECT version, time, symbol, rank FROM r WHERE rank <= 2""")
def position_ranks(spark, sf_dir):
    w = Window.partitionBy("version", "symbol").orderBy("time")
    return sequences(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("version", "time", "symbol", "rank")


@query(f"""WITH {SEQ}, v AS (SELECT DISTINCT version FROM seq), s AS (SELECT DISTINCT symbol FROM seq)
SELECT v.version, s.symbol, count(q.time) AS n FROM v CROSS JOIN s LEFT JOIN seq q ON q.version = v.version AND q.symbol = s.symbol GROUP BY ALL""")
def symbol_histogram(spark, sf_dir):
    return stats.vocabulary_histogram(sequences(spark, sf_dir), "version", "symbol")


@query(f"""WITH {SEQ}, v AS (SELECT DISTINCT version FROM seq), s AS (SELECT DISTINCT symbol FROM seq),
n AS (SELECT v.version, s.symbol, count(q.time) AS n FROM v CROSS JOIN s LEFT JOIN seq q ON q.version = v.version AND q.symbol = s.symbol GROUP BY ALL)
SELECT version, symbol, round(n / sum(n) OVER (PARTITION BY version), 6) AS freq FROM n""")
def symbol_freq_vector(spark, sf_dir):
    return stats.frequencies(stats.vocabulary_histogram(sequences(spark, sf_dir), "version", "symbol"), "version")


@query(f"""WITH {SEQ}, n AS (SELECT version, symbol, count(*) AS n FROM seq GROUP BY ALL), p AS (SELECT version, n / sum(n) OVER (PARTITION BY version) AS p FROM n)
SELECT version, round(-sum(p * ln(p)), 6) AS entropy FROM p GROUP BY version""")
def symbol_entropy(spark, sf_dir):
    return stats.entropy(sequences(spark, sf_dir), "version", "symbol")


@query(f"""WITH {SEQ}, l AS (SELECT version, list(value ORDER BY value) AS l, round(stddev_samp(value), 6) AS sd, round(median(value), 6) AS median FROM seq GROUP BY version)
SELECT version, sd, median, l[CAST(floor(len(l) / 2.0 + 0.5) AS INTEGER) + 1] AS published_median FROM l""")
def value_stats_quirk_median(spark, sf_dir):
    return stats.value_stats(sequences(spark, sf_dir), "version", "value")


@query(f"""WITH {SEQ}, n AS (SELECT collection, k, count(*) AS n, min(version * 1000000 + time) AS f FROM seq GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY n DESC, f DESC) AS rank FROM n) SELECT collection, k, n, rank FROM r WHERE rank <= 5""")
def most_common_points(spark, sf_dir):
    return stats.most_common(sequences(spark, sf_dir), ["collection"], "k", ["version", "time"], 5)


@query("""WITH n AS (SELECT conv_id, count(*) AS turns FROM conversations GROUP BY 1), b AS (SELECT min(turns) AS lo, max(turns) AS hi FROM n),
s AS (SELECT unnest(range(lo, hi + 1)) AS bin FROM b) SELECT s.bin, count(n.turns) AS n FROM s LEFT JOIN n ON n.turns = s.bin GROUP BY 1""")
def dense_histogram(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return stats.dense_histogram(turns, "turns")


@query(f"""WITH {SEQ}, g AS (SELECT version, time, CASE WHEN time % 3 = 1 THEN k::DOUBLE END AS v FROM seq),
a AS (SELECT version, time, v, last_value(v IGNORE NULLS) OVER b AS lo, last_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER b AS lo_at,
 first_value(v IGNORE NULLS) OVER n AS hi, first_value(CASE WHEN v IS NOT NULL THEN time END IGNORE NULLS) OVER n AS hi_at FROM g
 WINDOW b AS (PARTITION BY version ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY version ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT version, time, round(CASE WHEN v IS NOT NULL THEN v WHEN lo IS NULL THEN 0.0 WHEN hi IS NULL THEN lo + (time - lo_at) ELSE lo + (hi - lo) * (time - lo_at) / (hi_at - lo_at) END, 6) AS v FROM a""")
def filled_gaps(spark, sf_dir):
    g = sequences(spark, sf_dir).select("version", "time", F.when(F.col("time") % 3 == 1, F.col("k").cast("double")).alias("v"))
    return sequence.fill_gaps(g, ["version"], "time", "v").withColumn("v", F.round("v", 6))


@query("""WITH f AS (SELECT l_orderkey AS song, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame, l_returnflag AS chord FROM lineitem),
b AS (SELECT *, lag(chord) OVER (PARTITION BY song ORDER BY frame) AS b FROM f), r AS (SELECT * FROM b WHERE b IS DISTINCT FROM chord)
SELECT song, chord, round(frame * 2048 / 44100, 6) AS "start", round(lead(frame) OVER (PARTITION BY song ORDER BY frame) * 2048 / 44100, 6) AS "end" FROM r""")
def framewise_chords(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("song"), nth.alias("frame"), F.col("l_returnflag").alias("chord"))
    out = sequence.frame_changes(f, "song", "chord")
    return out.select("song", "chord", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


_NAMES = "['C','Db','D','Eb','E','F','F#','G','Ab','A','Bb','B']"


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 12 AS root, (p_partkey // 12) % 4 AS t FROM part)
SELECT p_partkey, list_sort([CAST((root + x) % 12 AS INTEGER) FOR x IN CASE t WHEN 0 THEN [0,4,7] WHEN 1 THEN [0,3,7] WHEN 2 THEN [0,4,8] ELSE [0,3,6] END]) AS pcs FROM p""")
def go_index_pcsets(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", theory.index_to_pc_set((F.col("p_partkey") % 48).cast("int")).alias("pcs"))


@query(f"""WITH p AS (SELECT p_partkey, p_partkey % 12 AS root, (p_partkey // 12) % 4 AS t FROM part)
SELECT p_partkey, CASE WHEN t = 2 THEN {_NAMES}[CASE root % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END + 1] ELSE {_NAMES}[root + 1] END
  || CASE t WHEN 0 THEN '' WHEN 1 THEN 'm' WHEN 2 THEN '+' ELSE '°' END AS label FROM p""")
def pcset_labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", theory.pc_set_label(theory.index_to_pc_set((F.col("p_partkey") % 48).cast("int"))).alias("label"))


@query("""WITH k AS (SELECT p_partkey, p_partkey % 12 AS a, p_size % 12 AS b, CASE WHEN p_partkey % 5 < 2 THEN 'minor' ELSE 'major' END AS ma, CASE WHEN p_size % 3 = 0 THEN 'minor' ELSE 'major' END AS mb FROM part),
m AS (SELECT *, CASE WHEN ma = 'minor' THEN a + 3 ELSE a END AS ra, CASE WHEN mb = 'minor' THEN b + 3 ELSE b END AS rb FROM k),
d AS (SELECT *, CASE WHEN ma = mb THEN (b - a + 24) % 12 ELSE (rb - ra + 24) % 12 END AS d FROM m)
SELECT p_partkey, CAST(CASE WHEN a = b OR (ra - rb + 24) % 12 = 0 THEN 0 WHEN d > 6 THEN d - 12 ELSE d END AS INTEGER) AS difference FROM d""")
def key_differences(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mode = lambda c: F.when(c, "minor").otherwise("major")
    d = theory.key_difference(F.col("p_partkey") % 12, mode(F.col("p_partkey") % 5 < 2), F.col("p_size") % 12, mode(F.col("p_size") % 3 == 0))
    return p.select("p_partkey", d.alias("difference"))


@query("""WITH t AS (SELECT p_partkey, CAST(p_partkey % 13 AS INTEGER) - 6 AS d, p_retailprice AS c FROM part)
SELECT p_partkey, round(pow(2.0, CASE WHEN abs(d) > 3 THEN 0 ELSE d END / 12.0) * 440.0 / c, 9) AS ratio FROM t""")
def tuning_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(theory.tuning_ratio(F.col("p_partkey") % 13 - 6, F.lit(440.0), "p_retailprice"), 9).alias("ratio"))


_SEGMENTS = """g AS (SELECT version, CAST(floor(start / 86400) AS BIGINT) AS i, min(start) AS lo FROM seq GROUP BY ALL),
seg AS (SELECT version, i, i * 86400.0 AS s0, (i + 1) * 86400.0 AS s1 FROM g),
lab AS (SELECT version, time AS idx, symbol AS label, value, start AS l0, lead(start) OVER (PARTITION BY version ORDER BY time) AS l1 FROM seq)"""


def _days(seq):
    day = F.floor(F.col("start") / 86400)
    s = seq.select("version", day.alias("i")).distinct()
    return s.select("version", "i", (F.col("i") * 86400.0).alias("start"), ((F.col("i") + 1) * 86400.0).alias("end"))


def _intervals(seq):
    w = Window.partitionBy("version").orderBy("time")
    return seq.select("version", F.col("time").alias("idx"), F.col("symbol").alias("label"), "value", "start", F.lead("start").over(w).alias("end")).where("end IS NOT NULL")


@query(f"""WITH {SEQ}, {_SEGMENTS},
o AS (SELECT s.version, s.i, l.label, l.idx, least(s1, l1) - greatest(s0, l0) AS o FROM seg s JOIN lab l ON s.version = l.version AND l.l0 < s.s1 AND l.l1 > s.s0),
r AS (SELECT *, row_number() OVER (PARTITION BY version, i ORDER BY o DESC, idx) AS r FROM o),
near AS (SELECT s.version, s.i, coalesce((SELECT l.label FROM lab l WHERE l.version = s.version AND l.l0 <= s.s0 ORDER BY l.l0 DESC, l.idx DESC LIMIT 1), (SELECT l.label FROM lab l WHERE l.version = s.version ORDER BY l.l0, l.idx LIMIT 1)) AS label FROM seg s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.version = s.version AND o.i = s.i))
SELECT version, i, label, round(o, 3) AS overlap FROM r WHERE r = 1 UNION ALL SELECT version, i, label, 0 FROM near""")
def interval_overlap_argmax(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    out = interval.overlap_argmax(_days(seq), _intervals(seq), "version", width=86400.0)
    return out.select("version", "i", "label", F.round("overlap", 3).alias("overlap"))


@query(f"""WITH {SEQ}, {_SEGMENTS},
m AS (SELECT s.version, s.i, l.value FROM seg s JOIN lab l ON s.version = l.version AND l1 IS NOT NULL AND ((l0 >= s0 AND l0 < s1) OR (l0 < s0 AND s0 <= l1)))
SELECT version, i, round(avg(value), 6) AS mean, count(*) AS events FROM m GROUP BY ALL""")
def interval_group_means(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    events = _intervals(seq).withColumn("duration", F.col("end") - F.col("start"))
    met = interval.group_events(_days(seq), events, "version", width=86400.0)
    return met.groupBy("version", "i").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("events"))


@query("""WITH n AS (SELECT l_orderkey AS song, CAST(l_partkey % 12 AS INTEGER) AS pc, sum(l_quantity) AS dur, min(l_linenumber) AS t FROM lineitem WHERE l_quantity > 10 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY song ORDER BY dur DESC, t, pc) AS r FROM n)
SELECT song, list(pc ORDER BY pc) AS pcs FROM r WHERE r <= 3 GROUP BY song""")
def transcription_pcsets(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").where("l_quantity > 10")
    n = n.groupBy(F.col("l_orderkey").alias("song"), (F.col("l_partkey") % 12).cast("int").alias("pc")).agg(F.sum("l_quantity").alias("dur"), F.min("l_linenumber").alias("t"))
    w = Window.partitionBy("song").orderBy(F.desc("dur"), "t", "pc")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("song").agg(F.array_sort(F.collect_list("pc")).alias("pcs"))


_SNAP = """beat AS (SELECT version, start AS t, row_number() OVER (PARTITION BY version ORDER BY start) - 1 AS n FROM seq WHERE symbol <> 'error'),
snap AS (SELECT s.version, s.time, arg_min(b.n, abs(b.t - s.start) * 1000000000 + b.n) AS beat FROM seq s JOIN beat b USING (version) WHERE s.symbol = 'error' GROUP BY ALL)"""


def _snapped(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    beats = seq.where("symbol <> 'error'").select("version", "start")
    beats = beats.withColumn("beat", (F.row_number().over(Window.partitionBy("version").orderBy("start")) - 1).cast("long"))
    chords = seq.where("symbol = 'error'").select("version", "time", "start")
    return interval.nearest(chords, beats, "version", "start", "beat").select("version", "time", "beat")


@query(f"WITH {SEQ}, {_SNAP} SELECT version, time, beat FROM snap")
def nearest_beat_snap(spark, sf_dir):
    return _snapped(spark, sf_dir)


@query(f"""WITH {SEQ}, {_SNAP}, v AS (SELECT version, beat % 4 AS phase, count(*) AS votes FROM snap GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY votes DESC, phase) AS r FROM v)
SELECT version, phase, votes FROM r WHERE r = 1""")
def meter_phase_vote(spark, sf_dir):
    return interval.meter_phase(_snapped(spark, sf_dir), "version", "beat")


@query("""WITH c AS (SELECT c_custkey, min(o_orderdate) AS d FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
e AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders)
SELECT o_custkey AS version, o_orderkey AS beat, (SELECT max(g.i) FROM (SELECT i * 90 * 86400.0 + epoch(TIMESTAMP '1992-01-01') AS t, i FROM range(0, 60) r(i)) g WHERE g.t <= epoch(e.o_orderdate)) AS grid FROM e""")
def timegrid_asof(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("version"), F.col("o_orderkey").alias("beat"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("at"))
    zero = 694224000.0  # 1992-01-01
    grid = e.select("version").distinct().withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(59)).cast("array<long>")))
    grid = grid.withColumn("at", F.col("grid") * 90 * 86400.0 + zero)
    return interval.as_of(e, grid, "version", "at", "grid").select("version", "beat", "grid")


@query(f"""WITH {SEQ}, b AS (SELECT version, time, symbol, lag(symbol) OVER (PARTITION BY version ORDER BY time) AS b FROM seq), s AS (SELECT version, time, symbol, coalesce(lead(time) OVER (PARTITION BY version ORDER BY time) - time, 1) AS length FROM b WHERE b IS DISTINCT FROM symbol),
n AS (SELECT *, count(*) OVER (PARTITION BY version, symbol) AS n FROM s) SELECT version, symbol, list(time ORDER BY time) AS starts, list(length ORDER BY time) AS lengths FROM n WHERE n > 1 GROUP BY ALL""")
def repeated_sections(spark, sf_dir):
    w = Window.partitionBy("version").orderBy("time")
    s = sequence.run_starts(sequences(spark, sf_dir)).withColumn("length", F.coalesce(F.lead("time").over(w) - F.col("time"), F.lit(1)))
    g = s.groupBy("version", "symbol").agg(F.array_sort(F.collect_list(F.struct("time", "length"))).alias("x")).where(F.size("x") > 1)
    return g.select("version", "symbol", F.col("x.time").alias("starts"), F.col("x.length").alias("lengths"))


@query("""WITH t AS (SELECT l_suppkey % 7 AS gt, row_number() OVER (PARTITION BY l_suppkey % 7 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seg, l_orderkey AS s0, l_orderkey + l_linenumber AS s1 FROM lineitem),
f AS (SELECT l_partkey % 5 AS pattern, row_number() OVER (PARTITION BY l_partkey % 5 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS occ, l_orderkey AS o0, l_orderkey + l_quantity::BIGINT % 5 AS o1 FROM lineitem),
m AS (SELECT pattern, gt, seg, s0, s1, occ, o0, o1, row_number() OVER (PARTITION BY pattern, gt, seg ORDER BY occ) AS r FROM t JOIN f ON o0 BETWEEN s0 AND s1 OR o1 BETWEEN s0 AND s1 OR (o0 < s0 AND o1 > s1)),
x AS (SELECT *, (least(s1, o1) - greatest(s0, o0) + 1) / (s1 - s0 + 1) AS share, count(*) OVER (PARTITION BY pattern, gt, o0 - s0) AS same FROM m WHERE r = 1),
c AS (SELECT gt, count(*) AS segs FROM t GROUP BY gt)
SELECT pattern, gt, round(sum(CASE WHEN same > 1 THEN share ELSE 0.0 END) / any_value(segs), 6) AS coverage FROM x JOIN c USING (gt) GROUP BY pattern, gt""")
def pattern_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    truth = li.withColumn("gt", F.col("l_suppkey") % 7).withColumn("seg", nth("gt")).select("gt", "seg", F.col("l_orderkey").alias("s0"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("s1"))
    found = li.withColumn("pattern", F.col("l_partkey") % 5).withColumn("occ", nth("pattern"))
    found = found.select("pattern", "occ", F.col("l_orderkey").alias("o0"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") % 5).alias("o1"))
    return interval.coverage(found, truth).withColumn("coverage", F.round("coverage", 6))
