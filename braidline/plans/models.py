"""Queries over classification, models, structure and sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import classify, experiment, hmm, partition, structure
from ..sources.views import SEQ, segment_edges, sequences, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def histogram_vectors(spark, sf_dir):
    """id, v, label: each version's symbol frequencies, labelled by its collection."""
    seq = sequences(spark, sf_dir)
    symbols = [r.symbol for r in seq.select("symbol").distinct().orderBy("symbol").collect()]
    n = F.count("*")
    cols = [(F.count(F.when(F.col("symbol") == s, 1)) / n) for s in symbols]
    return seq.groupBy(F.col("version").alias("id"), F.col("collection").alias("label")).agg(F.array(*cols).alias("v"))


_VEC = f"""{SEQ}, sym AS (SELECT list(DISTINCT symbol ORDER BY symbol) AS l FROM seq),
vec AS (SELECT version AS id, any_value(collection) AS label, [list_count(list_filter(list(symbol), y -> y = x)) / count(*) FOR x IN any_value(l)] AS v FROM seq, sym GROUP BY version),
pairs AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.id <> b.id AND a.id % 10 = 0)"""


def _query_pairs(spark, sf_dir):
    """Every tenth version as a query against all versions."""
    v = histogram_vectors(spark, sf_dir)
    return v, classify.pair_distances(v, v.where("id % 10 = 0"))


@query(f"""WITH {SEQ}, n AS (SELECT version, any_value(collection) AS label, count(*) AS t, {", ".join(f"count(*) FILTER (symbol = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view"))} FROM seq GROUP BY version)
SELECT version AS id, label, {", ".join(f"round({s} / t, 6) AS {s}" for s in ("click", "error", "purchase", "signup", "view"))} FROM n""")
def histogram_features(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    p = seq.groupBy(F.col("version").alias("id"), F.col("collection").alias("label")).pivot("symbol", ["click", "error", "purchase", "signup", "view"]).count().na.fill(0)
    total = sum((F.col(s) for s in ("error", "purchase", "signup", "view")), F.col("click"))
    return p.select("id", "label", *[F.round(F.col(s) / total, 6).alias(s) for s in ("click", "error", "purchase", "signup", "view")])


_EMB = """e AS (SELECT vec_id AS id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id AND a.id % 10 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p)"""


def _embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return e, e.where("id % 10 = 0")


@query(f"""WITH {_EMB}, n AS (SELECT r.a, e.label, count(*) AS n FROM r JOIN e ON e.id = r.b WHERE r <= 5 GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, label) AS k FROM n)
SELECT a AS id, label AS predicted FROM m WHERE k = 1""")
def knn_predict(spark, sf_dir):
    e, queries = _embeddings(spark, sf_dir)
    return classify.knn_predict(classify.nearest_rows(e, queries, 5), e.select("id", "label"), 5)


@query("""WITH e AS (SELECT vec_id AS id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM p) SELECT x.label, round(avg(CASE WHEN y.label = x.label THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM r JOIN e x ON x.id = r.a JOIN e y ON y.id = r.b WHERE r = 1 GROUP BY 1""")
def nearest_neighbor_rate(spark, sf_dir):
    """Of all vectors."""
    e, _ = _embeddings(spark, sf_dir)
    first = classify.knn_predict(classify.nearest_rows(e, e, 1), e.select("id", "label"), 1)
    hit = e.select("id", "label").join(first, "id")
    return hit.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("predicted")).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT conv_id, role, turn AS text FROM conversations), c AS (SELECT conv_id, count(*) AS c FROM t GROUP BY 1),
b AS (SELECT x.conv_id AS a, y.conv_id AS b, count(*) AS common FROM t x JOIN t y ON x.role = y.role AND x.text = y.text AND x.conv_id < y.conv_id GROUP BY ALL)
SELECT a, b, round((p.c + q.c - common - least(p.c, q.c)) / greatest(p.c, q.c), 6) AS ncd FROM b JOIN c p ON p.conv_id = a JOIN c q ON q.conv_id = b""")
def ncd_matrix(spark, sf_dir):
    """Complexity is the number of distinct places of roles; only pairs with a common one are
    listed (the others' distance is 1). ``cover_distances`` compresses by pattern covers."""
    from ..operators import patterns

    t = table(spark, sf_dir, "conversations").select("conv_id", F.struct("role", "turn").alias("token")).where("token.turn IS NOT NULL AND token.role IS NOT NULL")
    return patterns.ncd_pairs(t, "conv_id", "token", digits=6)


def conversation_points(spark, sf_dir):
    """piece, conv_id, t, y: a point a turn, y by its role and the scale of its length;
    pieces of at most 15 conversations."""
    turns = table(spark, sf_dir, "conversations").where("turn IS NOT NULL AND conv_id IS NOT NULL")
    role = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    scale = F.floor(F.log2(F.length(F.coalesce("text", F.lit(""))) + F.lit(1.0)))
    return turns.select(F.expr("conv_id div 15").alias("piece"), "conv_id", F.col("turn").alias("t"), (role * 64 + scale).cast("long").alias("y"))


@query()
def cover_distances(spark, sf_dir):
    """Normalised compression distances with pattern covers for a compressor."""
    from ..operators import align

    return align.compression_distances(conversation_points(spark, sf_dir), "piece", "conv_id").withColumn("ncd", F.round("ncd", 6))


@query()
def cover_nearest_rate(spark, sf_dir):
    """How often a conversation's nearest one by compression has as many turns."""
    from ..operators import align

    points = conversation_points(spark, sf_dir)
    turns = points.groupBy("conv_id").agg(F.count("*").alias("turns"))
    near = align.nearest_of_pairs(align.compression_distances(points, "piece", "conv_id"), "piece", "ncd")
    found = near.join(turns.withColumnRenamed("conv_id", "id"), "id").join(turns.select(F.col("conv_id").alias("nearest"), F.col("turns").alias("its")), "nearest")
    return found.groupBy("turns").agg(F.round(F.avg((F.col("turns") == F.col("its")).cast("double")), 6).alias("rate"), F.count("*").alias("n"))


@query(f"""WITH {_EMB}, s AS (SELECT a, round(sum(d), 4) AS total, arg_min(b, d) AS nearest, arg_max(b, d) AS farthest FROM p GROUP BY a) SELECT a AS id, total, nearest, farthest FROM s""")
def distance_outliers(spark, sf_dir):
    return classify.distance_sums(*_embeddings(spark, sf_dir)).withColumn("total", F.round("total", 4))


@query("""WITH c AS (SELECT vec_id % 37 AS cluster, label, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, label) AS r FROM c)
SELECT cluster, label, size::BIGINT AS size, n AS hits FROM r WHERE r = 1 AND size > 1""")
def cluster_mode_purity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return classify.purity(e.select("id", (F.col("id") % 37).alias("cluster")), e)


@query()
def dbscan(spark, sf_dir):
    """Within a collection, so that pairs stay inside it."""
    return classify.dbscan_points(histogram_vectors(spark, sf_dir), "label", 0.085, 4)


@query()
def ward(spark, sf_dir):
    v = histogram_vectors(spark, sf_dir)
    return classify.grouped_points(v, "label", lambda ids, x: list(zip(ids, classify.ward_labels(x, 3))), "id long, cluster long")


@query()
def optics(spark, sf_dir):
    v = histogram_vectors(spark, sf_dir)
    return classify.grouped_points(v, "label", lambda ids, x: [(ids[i], n, r) for n, (i, r) in enumerate(classify.optics_order(x, 4))], "id long, position long, reachability double")


@query()
def mds_embedding(spark, sf_dir):
    return classify.mds_points(histogram_vectors(spark, sf_dir), "label")


def _chat(spark, sf_dir):
    """Conversations as versions of ten collections, roles as symbols."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") % 10).alias("collection"), F.col("conv_id").alias("version"), F.col("turn").alias("time"), F.col("role").alias("symbol"))


@query()
def hmm_msa(spark, sf_dir):
    out = hmm.align_versions(_chat(spark, sf_dir))
    return out.withColumn("logp", F.round("logp", 6))


@query(f"""WITH {SEQ}, m AS (SELECT collection, version, time, CASE WHEN k < 70 THEN k // 7 + 1 END AS state FROM seq), v AS (SELECT collection, count(DISTINCT version) AS v, round(avg(CASE WHEN state IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS matched FROM m GROUP BY 1),
s AS (SELECT collection, state, count(DISTINCT version) AS n FROM m WHERE state IS NOT NULL GROUP BY ALL), o AS (SELECT s.collection, count(*) AS c FROM s JOIN v USING (collection) WHERE n > 0.5 * v GROUP BY 1)
SELECT collection, matched, coalesce(c, 0) AS states_in_most FROM v LEFT JOIN o USING (collection)""")
def msa_stats(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    m = seq.select("collection", "version", "time", F.when(F.col("k") < 70, F.floor(F.col("k") / 7) + 1).alias("state"))
    return hmm.msa_stats(m, ["collection"])


def _timeline(spark, sf_dir):
    """Slices of the conversations' alignment, all of them, and their matrix."""
    from ..plans.storage import materialise

    chat = _chat(spark, sf_dir)
    msa = materialise(hmm.align_versions(chat), "msa")
    part = hmm.states_to_slices(msa, ["collection"])
    part = part.join(chat, ["collection", "version", "time"])
    same = part.select("collection", "symbol", F.col("slice").alias("i"), "version")
    n = same.join(same.select("collection", "symbol", F.col("i").alias("j"), F.col("version").alias("w")), ["collection", "symbol"]).where("i <> j AND version = w")
    return chat, part, n.groupBy("collection", "i", "j").agg(F.count("*").alias("n"))


@query()
def timeline_sections(spark, sf_dir):
    return structure.sections(_timeline(spark, sf_dir)[2], ["collection"])


@query()
def harmonic_essence(spark, sf_dir):
    """The whole path: alignment, slices, sections, pooled labels, labelled sequences,
    and how often a label is what stood there."""
    chat, part, matrix = _timeline(spark, sf_dir)
    labels = structure.section_labels(part, structure.sections(matrix, ["collection"]), ["collection"], "symbol")
    out = structure.annotate(chat, part, labels, ["collection"], "symbol")
    return out.groupBy("collection").agg(F.count("*").alias("beats"), F.round(F.avg((F.col("label") == F.col("symbol")).cast("double")), 6).alias("agreement"))


@query(f"""WITH {SEQ}, p AS (SELECT version, time, symbol, k // 10 AS slice FROM seq WHERE k < 50), n AS (SELECT slice, symbol, count(*) AS n, min(version) AS seen FROM p GROUP BY ALL), l AS (SELECT slice, symbol AS label, row_number() OVER (PARTITION BY slice ORDER BY n DESC, seen DESC, symbol DESC) AS r FROM n)
SELECT s.version, s.time, coalesce(l.label, s.symbol) AS label FROM seq s LEFT JOIN p USING (version, time) LEFT JOIN l ON l.slice = p.slice AND l.r = 1""")
def annotated_labels(spark, sf_dir):
    from ..operators import sequence

    seq = sequences(spark, sf_dir).withColumn("one", F.lit(0))
    part = seq.where("k < 50").withColumn("slice", F.floor(F.col("k") / 10))
    labels = sequence.mode_labels(part, ["one", "slice"]).select("one", "slice", "label")
    return structure.annotate(seq, part, labels, ["one"], "symbol").select("version", "time", "label")


_GRID = {"iterations": [1, 2, 5], "length": ["median", "max"], "match": [0.9, 0.999]}


@query("""WITH g AS (SELECT i AS iterations, l AS length, m AS match FROM (VALUES (1), (2), (5)) a(i), (VALUES ('median'), ('max')) b(l), (VALUES (0.9), (0.999)) c(m)),
log AS (SELECT r_regionkey % 3 AS i, CASE WHEN r_regionkey % 2 = 0 THEN 'median' ELSE 'max' END AS l FROM region)
SELECT iterations, length, match::DOUBLE AS match FROM g WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.i = g.iterations AND log.l = g.length)""")
def config_grid_resume(spark, sf_dir):
    log = table(spark, sf_dir, "region").select((F.col("r_regionkey") % 3).alias("iterations"), F.when(F.col("r_regionkey") % 2 == 0, "median").otherwise("max").alias("length"), F.lit(1.0).alias("result"))
    return experiment.pending(experiment.config_grid(spark, _GRID), log)


@query("""SELECT n_nationkey AS id, n_name AS name, NULL::INTEGER AS region FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey >= 20""")
def config_log_evolve(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.where("n_nationkey < 5").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return experiment.append(old, n.where("n_nationkey >= 20").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem GROUP BY ALL""")
def log_summary(spark, sf_dir):
    out = experiment.summarise(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity"])
    return out.withColumn("mean_l_quantity", F.round("mean_l_quantity", 6))


@query(f"""WITH {SEQ}, p AS (SELECT collection, version, k // 10 AS slice, min(time) AS time FROM seq GROUP BY ALL), d AS (SELECT collection, slice, lead(time) OVER w - time AS dt, lead(slice) OVER w - slice AS ds FROM p WINDOW w AS (PARTITION BY collection, version ORDER BY slice)),
s AS (SELECT collection, slice, sum(greatest(dt - ds, 0)) AS inserts FROM d WHERE dt IS NOT NULL GROUP BY ALL) SELECT collection, slice, inserts::BIGINT AS inserts FROM s WHERE inserts > 5""")
def section_boundaries(spark, sf_dir):
    seq = sequences(spark, sf_dir)
    p = seq.groupBy("collection", "version", F.floor(F.col("k") / 10).alias("slice")).agg(F.min("time").alias("time"))
    return structure.boundaries(p, ["collection"])
