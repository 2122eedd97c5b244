"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are put on a sphere (scaled by the largest norm, with one more component), so
that the largest inner product is the smallest Euclidean distance. Each table hashes a
vector by ``width`` hashes floor((a.v + b) / w) with Gaussian ``a``, which are 2-stable.
A query visits the bucket of its own hash and those perturbed by -1, 0 or +1 a hash, in
order of estimated success: the smaller the summed squared distances to the slots'
borders, the sooner. How many buckets it visits is fitted on a bounded sample; the
index holds every vector. Candidates of all tables are merged and reranked by the exact
inner product in double precision.

Equal vectors form a class that is indexed once with its smallest ids (k + 1 of them
settle any list, as ties go to smaller ids). Buckets are dealt to blocks of about
``block_rows`` vectors; a bucket above that size is split by id, and a query goes to
each part. So neither a common vector nor a full bucket meets in one task.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise


class Hashing:
    def __init__(self, dim: int, tables: int, width: int, slot: float, largest: float, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.dim, self.tables, self.width, self.slot, self.largest = dim, tables, width, slot, largest
        self.a = rng.normal(size=(tables, dim + 1, width))
        self.b = rng.uniform(0, slot, size=(tables, width))
        self.deltas = np.array(list(itertools.product((0, -1, 1), repeat=width)), "i8")
        self.probes = len(self.deltas)

    def lift(self, x, query: bool):
        """Vectors on the sphere."""
        import numpy as np

        norm = np.sqrt((x * x).sum(1))
        if query:
            return np.concatenate([x / norm[:, None], np.zeros((len(x), 1))], 1)
        y = x / self.largest
        return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]], 1)

    def place(self, x, table: int):
        return (x @ self.a[table] + self.b[table]) / self.slot

    def code(self, slots):
        """One number a bucket."""
        import numpy as np

        out = np.zeros(slots.shape[:-1], "i8")
        for j in range(self.width):
            out = out * 1_000_003 + slots[..., j]
        return out

    def visits(self, x, table: int, probes: int):
        """Bucket codes of each lifted query, in order of estimated success."""
        import numpy as np

        place = self.place(x, table)
        low = np.floor(place)
        inside = place - low
        # squared distance to the border crossed by 0, -1, +1
        cost = np.stack([np.zeros_like(inside), inside**2, (1 - inside) ** 2])
        kind = np.where(self.deltas == 0, 0, np.where(self.deltas < 0, 1, 2))
        total = sum(cost[kind[:, j], :, j] for j in range(self.width)).T
        order = np.argsort(total, axis=1, kind="stable")[:, :probes]
        return self.code(low.astype("i8")[:, None, :] + self.deltas[order])


def fit(sample, total: int, largest: float, *, k: int, tables: int, width: int, target: float, queries: int = 200) -> Hashing:
    """Choose the slot's width and the number of visits on a sample (driver, bounded).
    The sample's nearest k * sample / total stand for the table's nearest k. The choice
    reaches ``target`` on the sample: wide slots end in buckets that hold all of it."""
    import numpy as np

    dim = sample.shape[1]
    norms = np.sqrt((sample * sample).sum(1))
    near = max(1, min(k, round(k * len(sample) / max(1, total))))
    q = sample[:queries]
    scores = (q / np.sqrt((q * q).sum(1))[:, None]) @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argsort(-scores, axis=1, kind="stable")[:, :near]
    best, slot = None, 1.0
    # slots in units of the lifted vectors' own spread, so that near pairs often share one;
    # wider ones follow until the visits there are reach the target
    while slot <= 2.0 or best is None:
        h = Hashing(dim, tables, width, slot, largest)
        codes = [h.code(np.floor(h.place(h.lift(sample, False), t)).astype("i8")) for t in range(tables)]
        rank = np.full((len(q), len(sample)), h.probes)
        for t in range(tables):
            seen = h.visits(h.lift(q, True), t, h.probes)
            for i in range(len(q)):
                at = {c: r for r, c in enumerate(seen[i].tolist())}
                rank[i] = np.minimum(rank[i], [at.get(c, h.probes) for c in codes[t].tolist()])
        wanted = np.sort(np.take_along_axis(rank, top, 1).ravel())
        probes = int(wanted[min(len(wanted) - 1, int(np.ceil(target * len(wanted))) - 1)]) + 1
        share = float((rank < probes).mean())
        if probes <= h.probes and (best is None or share < best[0]):
            h.probes = probes
            best = (share, h)
        slot += 0.5 if slot < 2.0 else slot
    return best[1]


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """_id, _v (doubles) of vectors that take part; their number of components is the
    table's commonest (ties to the larger)."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & F.col("_v").isNotNull())
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("_v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("_v") == (sizes[0].d if sizes else 0))


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = 2, width: int = 6,
    target: float = 0.94, sample_rows: int = 4096, block_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which
    ``is_query`` (on ``_id``) holds, all candidates if there are fewer.

    Null ids and invalid vectors take no part. An id that occurs with several vectors is
    a row each. A query short of ``k`` (its buckets were empty) is compared with every
    class. An empty table gives no rows."""
    spark = vectors.sparkSession
    key = F.concat(F.hex(F.xxhash64("_v")), F.hex(F.xxhash64(F.reverse("_v"))))
    rows = materialise(valid_vectors(vectors, id_col, vec_col).withColumn("_key", key), "ann-rows")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_id")))
    classes = ranked.where(F.col("_r") <= k + 1).groupBy("_key").agg(
        F.min("_id").alias("_cid"), F.sort_array(F.collect_list("_id")).alias("_ids"), F.first("_v").alias("_v")
    )
    classes = materialise(classes, "ann-classes")
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    total, largest = classes.agg(F.count("*"), F.max(norm)).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out_schema)
    import numpy as np

    sample = np.array([r._v for r in classes.orderBy(F.xxhash64("_key"), "_key").limit(sample_rows).select("_v").collect()])
    hashing = fit(sample, total, largest, k=k, tables=tables, width=width, target=target)
    blocks = max(1, -(-total * tables // block_rows))

    def bucketed(query: bool):
        def run(batches):
            import numpy as np
            import pandas as pd

            for pdf in batches:
                if not len(pdf):
                    continue
                lifted = hashing.lift(np.stack(pdf["_v"].to_numpy()), query)
                for t in range(tables):
                    if query:
                        seen = hashing.visits(lifted, t, hashing.probes)
                        yield pd.DataFrame({"_key": np.repeat(pdf["_key"].to_numpy(), seen.shape[1]), "_t": t, "_b": seen.ravel()})
                    else:
                        yield pdf.assign(_t=t, _b=hashing.code(np.floor(hashing.place(lifted, t)).astype("i8")))

        return run

    index = materialise(classes.mapInPandas(bucketed(False), "_key string, _cid long, _ids array<long>, _v array<double>, _t int, _b long"), "ann-index")
    large = index.groupBy("_t", "_b").count().where(F.col("count") > block_rows)
    large = large.select("_t", "_b", F.ceil(F.col("count") / block_rows).cast("int").alias("_parts"))
    block = F.pmod(F.xxhash64("_t", "_b", "_part"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("_key"), F.coalesce("_parts", F.lit(1))).cast("int")
    filed = index.join(large, ["_t", "_b"], "left").withColumn("_part", part).withColumn("_block", block).drop("_parts")

    asked = materialise(rows.where(is_query).select("_id", "_key"), "ann-asked")
    askers = classes.join(asked.select("_key").distinct(), "_key", "left_semi")
    probes = askers.select("_key", "_v").mapInPandas(bucketed(True), "_key string, _t int, _b long")
    sent = probes.join(large, ["_t", "_b"], "left").withColumn("_part", F.explode(F.expr("sequence(0, coalesce(_parts, 1) - 1)")))
    sent = sent.withColumn("_block", block).groupBy("_key", "_block").agg(F.collect_set(F.struct("_t", "_b")).alias("_probes"))
    sent = sent.join(askers.select("_key", F.col("_v").alias("_q")), "_key")

    def rerank(_, asking, filed):
        import numpy as np
        import pyarrow as pa

        names = ["_key", "_block", "_best"]
        if not asking.num_rows or not filed.num_rows:
            item = pa.struct([("far", pa.float64()), ("cid", pa.int64()), ("ids", pa.list_(pa.int64()))])
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.list_(item))], names)
        v = np.array(filed.column("_v").combine_chunks().flatten()).reshape(filed.num_rows, -1)
        q = np.array(asking.column("_q").combine_chunks().flatten()).reshape(asking.num_rows, -1)
        places: dict = {}
        for i, tb in enumerate(zip(filed.column("_t").to_pylist(), filed.column("_b").to_pylist())):
            places.setdefault(tb, []).append(i)
        cid = np.array(filed.column("_cid"))
        got_q, got_v, got_s = [], [], []
        for lo in range(0, len(q), 256):
            score = np.full((min(256, len(q) - lo), len(v)), -np.inf)
            by_bucket: dict = {}
            for i, probes in enumerate(asking.column("_probes").slice(lo, 256).to_pylist()):
                for p in probes if probes is not None else [{"_t": t, "_b": b} for t, b in places if t == 0]:
                    if (p["_t"], p["_b"]) in places:
                        by_bucket.setdefault((p["_t"], p["_b"]), []).append(i)
            for tb, who in by_bucket.items():
                at = np.array(places[tb])
                score[np.ix_(who, at)] = q[lo + np.array(who)] @ v[at].T
            most = min(2 * k + 10, score.shape[1])
            some = np.argpartition(-score, most - 1, axis=1)[:, :most]
            i = np.repeat(np.arange(len(score)), most)
            j = some.ravel()
            ok = score[i, j] > -np.inf
            i, j = i[ok], j[ok]
            exact = np.einsum("ij,ij->i", q[lo + i], v[j])
            order = np.lexsort((cid[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
            rank = np.arange(len(i)) - np.maximum.accumulate(np.where(first, np.arange(len(i)), 0))
            keep = rank < tables * (k + 1)  # a class may come from each table
            got_q.append(lo + i[keep]), got_v.append(j[keep]), got_s.append(exact[keep])
        who, gv = np.concatenate(got_q), pa.array(np.concatenate(got_v))
        some = pa.StructArray.from_arrays([pa.array(-np.concatenate(got_s)), filed.column("_cid").combine_chunks().take(gv), filed.column("_ids").combine_chunks().take(gv)], ["far", "cid", "ids"])
        asked = np.unique(who)
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(who, asked), len(who)).astype("i4")), some)
        block = filed.column("_block")[0].as_py()
        return pa.table([asking.column("_key").combine_chunks().take(pa.array(asked)), pa.array([block] * len(asked), pa.int32()), lists], names)

    found_schema = "_key string, _block int, _best array<struct<far:double,cid:bigint,ids:array<bigint>>>"

    def lists(sent):
        found = sent.groupBy("_block").cogroup(filed.groupBy("_block")).applyInArrow(rerank, found_schema)
        # lists meet 32 at a time, so no merge holds more than that however many blocks
        left = blocks
        while True:
            left = -(-left // 32)
            found = found.withColumn("_block", F.floor(F.col("_block") / 32).cast("int")).groupBy("_key", "_block")
            found = found.agg(F.sort_array(F.flatten(F.collect_list("_best"))).alias("_all"))
            # what several blocks found lies side by side once sorted
            alone = F.filter("_all", lambda x, i: (i == 0) | (x != F.get("_all", i - 1)))
            found = found.select("_key", "_block", F.slice(alone, 1, k + 1).alias("_best"))
            if left <= 1:
                return found.drop("_block")

    best = materialise(lists(sent), "ann-best")
    enough = F.aggregate("_best", F.lit(0), lambda s, x: s + F.size(x["ids"])) > k
    everything = rows.count()
    short = askers.select("_key", "_v")
    if everything > k:
        short = short.join(best.where(enough), "_key", "left_anti")
    short = materialise(short, "ann-short")
    if short.count():
        full = short.withColumn("_block", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
        no_probes = F.lit(None).cast("array<struct<_t:int,_b:bigint>>")
        again = lists(full.select("_key", "_block", no_probes.alias("_probes"), F.col("_v").alias("_q")))
        best = best.join(short, "_key", "left_anti").unionByName(again)
    pairs = asked.join(best, "_key").select(F.col("_id").alias("query_id"), F.explode("_best").alias("_c"))
    pairs = pairs.select("query_id", F.explode("_c.ids").alias("vec_id"), (-F.col("_c.far")).alias("score")).where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
