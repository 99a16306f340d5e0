"""Queries over the operators, each with SQL where SQL can say it.

Vectors come from the table embeddings: bytes are floor((e + 1) * 128), wrapped
bytes 37 times that modulo 256, words the sign bits. Search queries ask for every
row whose id is divisible by 50. Vector results are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import kernels as K
from ..functions import vectors as V
from ..operators import focus, ghosts, graph, holograph, index, layers, learn, oracle, phase, recognise, search, sweep
from ..sources import records
from . import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text(vector: str | Column) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def word(bits: Callable[[Column], Column], first: int, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(first), F.lit(first + n - 1)), F.lit(0).cast("long"), lambda t, i: t + F.when(bits(i), V.bit(i - first)).otherwise(F.lit(0).cast("long")))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, ph (bytes), wr (wrapped bytes), w (two sign words), up (two words of e[i] < e[i + 1])."""
    e = F.col("embedding")
    sign = lambda i: F.get(e, i) < 0
    rises = lambda i: F.get(e, i) < F.get(e, (i + 1) % 64)
    rows = table(spark, sf, "embeddings").withColumn("ph", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 128).cast("int")))
    rows = rows.withColumn("wr", F.transform("ph", lambda x: x * 37 % 256)).withColumn("w", F.array(word(sign, 0, 32), word(sign, 32, 32))).withColumn("up", F.array(word(rises, 0, 32), word(rises, 32, 32)))
    return rows.select("vec_id", "label", "ph", "wr", "w", "up")


#: The same table in DuckDB.
VECTORS = """
v0 AS (SELECT vec_id, label, embedding AS e, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 128) AS BIGINT)) AS ph FROM embeddings),
v AS (SELECT vec_id, label, ph, list_transform(ph, lambda x: x * 37 % 256) AS wr,
  [CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 1] < 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT), CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 33] < 0 THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)] AS w,
  [CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 1] < e[(i + 1) % 64 + 1] THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT), CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN e[i + 33] < e[(i + 33) % 64 + 1] THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)] AS up
  FROM v0)
"""


def ham(a: str, b: str) -> str:
    return f"CAST(bit_count(xor({a}[1], {b}[1])) + bit_count(xor({a}[2], {b}[2])) AS BIGINT)"


def l1(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))) AS BIGINT)"


def circ(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, len({a}) + 1), lambda i: least(abs({a}[i] - {b}[i]), 256 - abs({a}[i] - {b}[i])))) AS BIGINT)"


def joined(v: str) -> str:
    return f"array_to_string({v}, ',')"


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector (a_) beside that of the next id (b_)."""
    v = vectors(spark, sf)
    a = v.select(*[F.col(c).alias(f"a_{c}") for c in v.columns])
    b = v.select(*[F.col(c).alias(f"b_{c}") for c in v.columns])
    return a.join(b, F.col("b_vec_id") == F.col("a_vec_id") + 1)


PAIRS = f"WITH {VECTORS}, p AS (SELECT a.vec_id, a.ph AS ap, b.ph AS bp, a.wr AS aw, b.wr AS bw, a.w AS wa, b.w AS wb FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"

# ---- search


@query(f"WITH {VECTORS} SELECT v.vec_id, {ham('v.w', 'q.w')} AS dist FROM v, v q WHERE q.vec_id = 0 AND {ham('v.w', 'q.w')} <= 30")
def flat_scan_hamming(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("vec_id = 0").select(F.col("w").alias("q"))  # the query vector
    return search.scan(v.join(F.broadcast(asked)), "w", F.col("q"), 30).select("vec_id", "dist")


@query(f"WITH {VECTORS} SELECT q.vec_id AS query_id, v.vec_id AS row_id, {ham('v.w', 'q.w')} AS dist FROM v, v q WHERE q.vec_id % 50 = 0 AND {ham('v.w', 'q.w')} <= 30")
def flat_scan_hamming_set(spark, sf):
    v = vectors(spark, sf).select(F.col("vec_id").alias("row_id"), "w")
    asked = v.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), F.col("w").alias("q"))
    return search.scan(search.against(v, asked), "w", F.col("q"), 30).select("query_id", "row_id", "dist")


def channels(spark, sf) -> DataFrame:
    return vectors(spark, sf).select(F.col("vec_id").alias("row_id"), F.col("w").alias("meta"), V.sort_phase("ph")["sorted"].alias("cam"), F.col("up").alias("btree"), F.col("wr").alias("embed"))


CHANNELS = f"{VECTORS}, c AS (SELECT vec_id AS row_id, w AS meta, list_sort(ph) AS cam, up AS btree, wr AS embed FROM v), q AS (SELECT * FROM c WHERE row_id % 50 = 0)"


@query(f"""WITH {CHANNELS} SELECT * FROM (SELECT q.row_id AS query_id, c.row_id, {ham('c.meta', 'q.meta')} AS meta_hamming, {ham('c.btree', 'q.btree')} AS btree_hamming, {l1('c.cam', 'q.cam')} AS cam_wasserstein, {circ('c.embed', 'q.embed')} AS embed_circular FROM c, q)
WHERE meta_hamming <= 30 AND btree_hamming <= 32 AND cam_wasserstein <= 200 AND embed_circular <= 4100""")
def hybrid_search(spark, sf):
    c = channels(spark, sf)
    return search.search(c, c.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id"), search.HYBRID, (30, 32, 200, 4100))


@query(f"""WITH {CHANNELS} SELECT * FROM (SELECT q.row_id AS query_id, c.row_id, {ham('c.meta', 'q.meta')} AS meta_hamming, {ham('c.btree', 'q.btree')} AS btree_hamming, {l1('c.cam', 'q.cam')} AS cam_carrier, {l1('c.embed', 'q.embed')} AS embed_carrier FROM c, q)
WHERE meta_hamming <= 30 AND btree_hamming <= 32 AND cam_carrier <= 200 AND embed_carrier <= 5500""")
def carrier_search(spark, sf):
    c = channels(spark, sf)
    return search.search(c, c.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id"), search.CARRIER, (30, 32, 200, 5500))


def quarter_words(spark, sf) -> DataFrame:
    """Four channels of 32 bits in a word each."""
    v = vectors(spark, sf)
    one = lambda c, i: F.array(F.get(c, F.lit(i)), F.lit(0).cast("long"))
    return v.select(F.col("vec_id").alias("row_id"), "label", one("w", 0).alias("meta"), one("w", 1).alias("cam"), one("up", 0).alias("btree"), one("up", 1).alias("embed"))


QUARTERS = f"{VECTORS}, r AS (SELECT vec_id AS row_id, label, [w[1], 0::BIGINT] AS meta, [w[2], 0::BIGINT] AS cam, [up[1], 0::BIGINT] AS btree, [up[2], 0::BIGINT] AS embed FROM v)"
CASCADE = ", ".join(f"{ham(f'r.{c}', f'q.{c}')} AS {c}_dist" for c in records.CHANNELS)


@query(f"WITH {QUARTERS} SELECT * FROM (SELECT q.row_id AS query_id, r.row_id, {CASCADE} FROM r, r q WHERE q.row_id % 50 = 0) WHERE meta_dist <= 16 AND cam_dist <= 16 AND btree_dist <= 16 AND embed_dist <= 16")
def cascade_4ch(spark, sf):
    r = quarter_words(spark, sf).drop("label")
    return search.search(r, r.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id"), search.BINARY, (16, 16, 16, 16))


@query(f"WITH {VECTORS} SELECT query_id, row_id, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS row_id, {ham('v.w', 'q.w')} AS dist FROM v, v q WHERE q.vec_id % 50 = 0)) WHERE rank <= 5")
def knn_topk(spark, sf):
    v = vectors(spark, sf).select(F.col("vec_id").alias("row_id"), "w")
    return search.nearest(v, v.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id"), "w", 5)


def sampled(a: str, b: str, parts: int) -> str:
    n = 64 // parts
    return f"list_sum(list_transform(range(0, {n}), lambda i: abs({a}[i * {parts} + 1] - {b}[i * {parts} + 1])))"


@query(f"WITH {CHANNELS} SELECT q.row_id AS query_id, c.row_id, {l1('c.cam', 'q.cam')} AS dist FROM c, q WHERE {sampled('c.cam', 'q.cam', 16)} <= 160 // 16 + 160 // 32 AND {sampled('c.cam', 'q.cam', 4)} <= 160 // 4 + 160 // 16 AND {l1('c.cam', 'q.cam')} <= 160")
def wasserstein_adaptive(spark, sf):
    c = channels(spark, sf).select("row_id", "cam")
    return search.wasserstein_adaptive(c, c.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id"), "cam", 160)


# ---- cluster indexes: one centre a label, its least row


def indexed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    r = quarter_words(spark, sf)
    first = r.groupBy("label").agg(F.min_by(F.struct(*records.CHANNELS), "row_id").alias("c"))
    given = {c: first.select(F.col("label").alias("cluster_id"), F.col(f"c.{c}").alias("centre")) for c in records.CHANNELS}
    rows = r.drop("label")
    return rows, *index.build(rows, given=given)


def _index_sql(channel: str) -> str:
    return f"""{channel}_k AS (SELECT label AS cluster_id, {channel} AS centre FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY row_id) = 1),
{channel}_m AS (SELECT row_id, cluster_id, dist FROM (SELECT r.row_id, k.cluster_id, {ham(f'r.{channel}', 'k.centre')} AS dist FROM r, {channel}_k k) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, cluster_id) = 1),
{channel}_c AS (SELECT m.cluster_id, any_value(k.centre) AS centre, max(m.dist) AS radius, count(*) AS n FROM {channel}_m m JOIN {channel}_k k USING (cluster_id) GROUP BY m.cluster_id)"""


INDEX = f"{QUARTERS}, " + ", ".join(map(_index_sql, records.CHANNELS))


@query(f"WITH {INDEX} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, cluster_id, radius, n FROM {c}_c" for c in records.CHANNELS))
def index_clusters(spark, sf):
    return indexed(spark, sf)[1].select("channel", "cluster_id", "radius", "n")


@query(f"WITH {INDEX} SELECT q.row_id AS query_id, r.row_id, {ham('r.meta', 'q.meta')} AS dist FROM r, r q WHERE q.row_id % 50 = 0 AND {ham('r.meta', 'q.meta')} <= 4")
def indexed_search_meta(spark, sf):
    rows, clusters, members = indexed(spark, sf)
    asked = rows.where("row_id % 50 = 0").select(F.col("row_id").alias("query_id"), "meta")
    return index.search_many(rows, clusters, members, asked, "meta", 4)


@query(f"WITH {INDEX} SELECT row_id, meta_dist, cam_dist, btree_dist, embed_dist FROM (SELECT r.row_id, {CASCADE} FROM r, r q WHERE q.row_id = 0) WHERE meta_dist <= 16 AND cam_dist <= 16 AND btree_dist <= 17 AND embed_dist <= 17")
def indexed_search(spark, sf):
    rows, clusters, members = indexed(spark, sf)
    return index.search(rows, clusters, members, first_row(rows), (16, 16, 17, 17))[0]


def first_row(rows: DataFrame) -> dict[str, Column]:
    """Vectors of row 0; null where there is no such row, so that nothing is found."""
    q = rows.where("row_id = 0").first()
    return {c: F.array(*[F.lit(x).cast("long") for x in q[c]]) if q else F.lit(None).cast("array<bigint>") for c in records.CHANNELS}


def asked_rows(rows: DataFrame) -> DataFrame:
    return rows.where("row_id % 50 = 0").withColumnRenamed("row_id", "query_id")


@query(f"WITH {INDEX} SELECT * FROM (SELECT q.row_id AS query_id, r.row_id, {CASCADE} FROM r, r q WHERE q.row_id % 50 = 0) WHERE meta_dist <= 16 AND cam_dist <= 16 AND btree_dist <= 17 AND embed_dist <= 17")
def indexed_search_set(spark, sf):
    rows, clusters, members = indexed(spark, sf)
    return index.search_set(rows, clusters, members, asked_rows(rows), (16, 16, 17, 17))[0]


@query(oracles.counters(INDEX, ham, (10, 16, 17, 17)))
def indexed_search_counters(spark, sf):
    rows, clusters, members = indexed(spark, sf)
    return index.search_set(rows, clusters, members, asked_rows(rows), (10, 16, 17, 17))[1]


@query(f"WITH {INDEX} SELECT cluster_id, radius, 2 * n AS n FROM cam_c")
def index_insert(spark, sf):
    rows, clusters, members = indexed(spark, sf)
    again = rows.withColumn("row_id", F.col("row_id") + 1_000_000)
    return index.insert(clusters, members, again, "cam")[0].where("channel = 'cam'").select("cluster_id", "radius", "n")


# ---- distances and phase algebra


@query(f"""{PAIRS} SELECT vec_id, {l1('list_sort(ap)', 'list_sort(bp)')} AS wasserstein, {circ('aw', 'bw')} AS circular, {ham('wa', 'wb')} AS hamming, 1 - {ham('wa', 'wb')} / 64.0::DOUBLE AS similarity,
  CAST(list_sum(list_transform(range(0, 16), lambda b: abs(len(list_filter(aw, lambda x: x // 16 = b)) - len(list_filter(bw, lambda x: x // 16 = b))))) AS BIGINT) AS histogram_l1 FROM p""")
def vector_distances(spark, sf):
    hist = lambda c: F.transform(V.histogram16(c), lambda x: x.cast("long"))
    p = neighbours(spark, sf)
    return p.select(F.col("a_vec_id").alias("vec_id"), V.l1(V.sort_phase("a_ph")["sorted"], V.sort_phase("b_ph")["sorted"]).alias("wasserstein"), V.circular("a_wr", "b_wr").alias("circular"), V.hamming("a_w", "b_w").alias("hamming"), (1 - V.hamming("a_w", "b_w") / 64.0).alias("similarity"), V.l1(hist("a_wr"), hist("b_wr")).alias("histogram_l1"))


def dots(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - 128) * ({b}[i] - 128))) AS BIGINT)"


@query(f"""{PAIRS} SELECT vec_id, {l1('ap', 'bp')} AS l1, {dots('ap', 'bp')} AS dot, round({dots('ap', 'bp')} / (sqrt(CAST({dots('ap', 'ap')} AS DOUBLE)) * sqrt(CAST({dots('bp', 'bp')} AS DOUBLE))), 6) AS correlation FROM p""")
def waveform_distances(spark, sf):
    signed = lambda c: F.transform(F.col(c), lambda x: x - 128)
    p = neighbours(spark, sf).withColumn("a", signed("a_ph")).withColumn("b", signed("b_ph"))
    return p.select(F.col("a_vec_id").alias("vec_id"), V.l1("a", "b").alias("l1"), V.dot("a", "b").alias("dot"), F.round(V.cosine("a", "b", None), 6).alias("correlation"))


def zipped(expression: str) -> str:
    return joined(f"list_transform(range(1, 65), lambda i: {expression})")


@query(f"{PAIRS} SELECT vec_id, {zipped('(aw[i] + bw[i]) % 256')} AS bound, {zipped('((aw[i] - bw[i]) % 256 + 256) % 256')} AS unbound, {zipped('(256 - aw[i]) % 256')} AS inverse, {zipped('aw[i]')} AS round_trip FROM p")
def phase_algebra(spark, sf):
    p = neighbours(spark, sf)
    bound = V.phase_bind("a_wr", "b_wr")
    return p.select(F.col("a_vec_id").alias("vec_id"), text(bound).alias("bound"), text(V.phase_unbind("a_wr", "b_wr")).alias("unbound"), text(V.phase_inverse("a_wr")).alias("inverse"), text(V.phase_unbind(bound, "b_wr")).alias("round_trip"))


@query(f"""WITH {VECTORS}, s AS (SELECT vec_id, wr, list_sort(list_transform(range(1, 65), lambda i: {{'x': wr[i], 'i': i - 1}})) AS p FROM v)
SELECT vec_id, {joined('list_transform(p, lambda z: z.x)')} AS sorted, {joined('list_transform(p, lambda z: z.i)')} AS perm, {joined('wr')} AS unsorted, {joined('list_transform(range(0, 16), lambda b: len(list_filter(wr, lambda x: x // 16 = b)))')} AS histogram FROM s""")
def phase_sort(spark, sf):
    v = vectors(spark, sf).withColumn("s", V.sort_phase("wr"))
    return v.select("vec_id", text("s.sorted").alias("sorted"), text("s.perm").alias("perm"), text(V.unsort_phase("s.sorted", "s.perm")).alias("unsorted"), text(V.histogram16("wr")).alias("histogram"))


def bundled(value: str, vector: str = "wr") -> str:
    return f"WITH {VECTORS}, x AS (SELECT label, i, {value} AS b FROM (SELECT label, unnest(range(1, 65)) AS i, unnest({vector}) AS x FROM v) GROUP BY label, i) SELECT label, string_agg(CAST(b AS VARCHAR), ',' ORDER BY i) AS bundle FROM x GROUP BY label"


@query(bundled("CAST(sum(x) // count(*) AS BIGINT)"))
def bundle_mean(spark, sf):
    return phase.bundle_mean(vectors(spark, sf), "label", "wr").select("label", text("bundle").alias("bundle"))


_TURN = "atan2(sum(sin(x * 0.02454369260617026)), sum(cos(x * 0.02454369260617026))) * 40.74366543152521"


@query(bundled(f"least(255, CAST(round(CASE WHEN {_TURN} < 0 THEN {_TURN} + 256 ELSE {_TURN} END) AS BIGINT))"))
def bundle_circular(spark, sf):
    return phase.bundle_circular(vectors(spark, sf), "label", "wr").select("label", text("bundle").alias("bundle"))


@query(bundled("CAST(greatest(-100, least(100, sum(x - 128))) AS BIGINT)", "ph"))
def bundle_clamped(spark, sf):
    rows = vectors(spark, sf).withColumn("x", F.transform("ph", lambda x: x - 128))
    return phase.bundle_clamped(rows, "label", "x", -100, 100).select("label", text("bundle").alias("bundle"))


@query(bundled("CAST(CASE WHEN 2 * sum(x % 2) >= count(*) THEN 1 ELSE 0 END AS BIGINT)", "ph"))
def bundle_majority(spark, sf):
    return phase.bundle_majority(vectors(spark, sf).withColumn("x", F.transform("ph", lambda x: x % 2)), "label", "x").select("label", text("bundle").alias("bundle"))


@query(f"{PAIRS} SELECT vec_id, {zipped('xor(ap[i] % 2, bp[i] % 2)')} AS binary_bind, {zipped('(ap[i] % 5 + bp[i] % 5) % 5')} AS unsigned_bind, {zipped('greatest(-2, least(2, ap[i] % 5 - 2 + bp[i] % 5 - 2))')} AS signed_bind, {zipped('least(2, greatest(-2, CAST(round((ap[i] - 128) / 9.0) AS BIGINT)))')} AS quantized FROM p")
def base_binding(spark, sf):
    mod = lambda c, n, less=0: F.transform(F.col(c), _mod(n, less))
    p = neighbours(spark, sf)
    return p.select(F.col("a_vec_id").alias("vec_id"), text(V.bind(mod("a_ph", 2), mod("b_ph", 2), ("binary", 2))).alias("binary_bind"), text(V.bind(mod("a_ph", 5), mod("b_ph", 5), ("unsigned", 5))).alias("unsigned_bind"), text(V.bind(mod("a_ph", 5, 2), mod("b_ph", 5, 2), ("signed", 5))).alias("signed_bind"), text(V.quantize(F.transform("a_ph", lambda x: (x - 128) / 9.0), -2, 2)).alias("quantized"))


def _mod(n: int, less: int) -> Callable[[Column], Column]:
    return lambda x: x % n - less


@query(oracles.STREAMS)
def random_streams(spark, sf):
    """Of each supplier's name: its hash, the first values of the stream of that seed, and values of a base drawn from the rest."""
    def values(names: pd.Series) -> pd.DataFrame:
        rows = []
        for name in names:
            seed = K.fnv1a(name)
            stream = K.SplitMix(seed)
            rows.append((str(seed), ",".join(map(str, stream.take(3).tolist())), ",".join(map(str, stream.integers(-3, 3, 16).tolist()))))
        return pd.DataFrame(rows, columns=["hash", "stream", "drawn"])

    made = C.by_batch(values, "struct<hash:string,stream:string,drawn:string>")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), made(F.col("s_name")).alias("v")).select("id", "v.*")


@query(oracles.GENERATED)
def generated_templates(spark, sf):
    return oracle.generate_templates(spark, 20, 48, ("signed", 7), 2).select("concept_id", "axis", text("vec").alias("vec"))


@query(oracles.perturbed(VECTORS))
def perturbed_vectors(spark, sf):
    rows = vectors(spark, sf).withColumn("x", F.transform("ph", lambda x: x - 128))
    return rows.select("vec_id", text(C.perturb(F.col("x"), F.col("vec_id"), 2.0)).alias("vec"))


# ---- focus regions: bytes (id * 31 + j * 17) % 256 for each supplier, masks from its key


def regions(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    masks = s.select("id", (F.col("id") * 37 % 255 + 1).cast("int").alias("mx"), (F.col("id") * 53 % 255 + 1).cast("int").alias("my"), (F.col("id") * 7919 % 65535 + 1).alias("mz"))
    fill = lambda k: F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda j: ((F.col("id") * k + j * 17) % 256).cast("int"))
    return masks.withColumn("a", fill(31)).withColumn("b", fill(47)).withColumn("m", V.focus_mask("mx", "my", "mz"))


REGIONS = """s AS (SELECT s_suppkey AS id, s_suppkey * 37 % 255 + 1 AS mx, s_suppkey * 53 % 255 + 1 AS my, s_suppkey * 7919 % 65535 + 1 AS mz FROM supplier),
f AS (SELECT id, mx, my, mz, j, (id * 31 + j * 17) % 256 AS a, (id * 47 + j * 17) % 256 AS b, (mx >> (j // 256)) & 1 = 1 AND (my >> (j // 32 % 8)) & 1 = 1 AND (mz >> (j % 32)) & 1 = 1 AS m FROM (SELECT *, unnest(range(0, 2048)) AS j FROM s))"""


def checksum(v: str | Column) -> Column:
    column = F.col(v) if isinstance(v, str) else v
    return F.aggregate(F.transform(column, lambda x, i: (i + 1).cast("long") * x), F.lit(0).cast("long"), lambda t, x: t + x)


@query(f"""WITH {REGIONS} SELECT id, CAST(sum(CASE WHEN m THEN bit_count(xor(a, b)) ELSE 0 END) AS BIGINT) AS hamming, CAST(sum(CASE WHEN m THEN abs(a - b) ELSE 0 END) AS BIGINT) AS l1, CAST(count(*) FILTER (m) AS BIGINT) AS region,
 CAST(sum((j + 1) * CASE WHEN m THEN xor(a, b) ELSE a END) AS BIGINT) AS xored, CAST(sum((j + 1) * CASE WHEN m THEN a ELSE 0 END) AS BIGINT) AS read, CAST(sum((j + 1) * CASE WHEN m THEN (a + b) % 256 ELSE a END) AS BIGINT) AS added, CAST(sum((j + 1) * CASE WHEN m THEN (a - b + 256) % 256 ELSE a END) AS BIGINT) AS subtracted,
 CAST(count(*) FILTER (m AND xor(a, b) <> 0) AS BIGINT) AS changes, 8 + 3 * CAST(count(*) FILTER (m AND xor(a, b) <> 0) AS BIGINT) AS wire_size FROM f GROUP BY id""")
def focus_operators(spark, sf):
    r = regions(spark, sf)
    delta = V.masked(V.xor("a", "b"), "m")
    changes = F.size(V.compact_delta(delta)).cast("long")
    return r.select("id", V.popcount(delta).alias("hamming"), V.l1(V.masked("a", "m"), V.masked("b", "m")).alias("l1"), V.region_bytes("mx", "my", "mz").alias("region"), checksum(V.focus_xor("a", "m", "b")).alias("xored"), checksum(V.masked("a", "m")).alias("read"), checksum(V.focus_add("a", "m", "b")).alias("added"), checksum(V.focus_add("a", "m", "b", -1)).alias("subtracted"), changes.alias("changes"), (8 + 3 * changes).alias("wire_size"))


@query(f"WITH {REGIONS} SELECT id, CAST(sum((j + 1) * CASE WHEN m THEN b ELSE a END) AS BIGINT) AS patched FROM f GROUP BY id")
def compact_deltas(spark, sf):
    r = regions(spark, sf)
    return r.select("id", checksum(C.apply_compact(F.col("a"), V.compact_delta(V.masked(V.xor("a", "b"), "m")))).alias("patched"))


def registry(spark, sf) -> DataFrame:
    return regions(spark, sf).select(F.col("id").alias("seq"), V.pack_focus("mx", "my", "mz").alias("focus"), F.col("id").alias("concept_id"), "mx", "my", "mz")


_SHARED = "CAST(bit_count(a.mx & b.mx) AS BIGINT) * bit_count(a.my & b.my) * bit_count(a.mz & b.mz)"


@query(f"WITH {REGIONS} SELECT b.id AS region_id, a.id AS concept_id, CAST({_SHARED} AS BIGINT) AS overlap FROM s a, s b WHERE {_SHARED} > 0")
def focus_overlaps(spark, sf):
    r = registry(spark, sf)
    return focus.overlaps(r.select("seq", "focus", "concept_id"), r.select(F.col("concept_id").alias("region_id"), "mx", "my", "mz"))


@query(f"WITH {REGIONS} SELECT CAST(count(DISTINCT j) FILTER (m) AS BIGINT) AS covered FROM f")
def focus_coverage(spark, sf):
    return focus.coverage(registry(spark, sf))


@query("SELECT s_suppkey AS concept_id FROM supplier WHERE s_suppkey <> 1")
def focus_registry_remove(spark, sf):
    return focus.remove(registry(spark, sf).select("seq", "focus", "concept_id"), 1)[0].select("concept_id")


@query(oracles.focus_addresses())
def focus_addresses(spark, sf):
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("concept_id"))
    return ids.select("concept_id", *[C.concept_focus(F.col("concept_id"), d)[m].alias(f"{d}_{m}") for d in K.DENSITIES for m in ("mx", "my", "mz")])


@query(oracles.focus_carriers(REGIONS))
def focus_carriers(spark, sf):
    r = regions(spark, sf)
    encoded = C.focus_carrier_encode(F.lit(bytes(2048)), F.col("mx"), F.col("my"), F.col("mz"), (F.col("id") % 16).cast("int"), F.lit(0.7), F.lit(5.0))
    return r.select("id", F.md5(encoded).alias("digest"))


# ---- layers: each line of an order is a layer over the order's ground


def order_layers(spark, sf) -> tuple[DataFrame, DataFrame]:
    ground = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.array(F.col("o_custkey"), F.col("o_orderkey") * 31).alias("value"))
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), seq.cast("long").alias("layer_seq"), F.array(F.col("l_partkey"), F.col("l_suppkey") * 65537).alias("delta"))
    return ground, lines


LAYERS = """g AS (SELECT o_orderkey AS key, o_custkey AS g1, o_orderkey * 31 AS g2 FROM orders),
l AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS layer_seq, l_partkey AS d1, l_suppkey * 65537 AS d2 FROM lineitem)"""


@query(f"WITH {LAYERS}, x AS (SELECT key, bit_xor(d1) AS d1, bit_xor(d2) AS d2, count(*) AS depth FROM l GROUP BY key) SELECT g.key, xor(g1, coalesce(d1, 0)) AS first, xor(g2, coalesce(d2, 0)) AS second, coalesce(depth, 0) AS depth FROM g LEFT JOIN x USING (key)")
def xor_layers(spark, sf):
    return layers.read_all(*order_layers(spark, sf)).select("key", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(1)).alias("second"), "depth")


@query(f"WITH {LAYERS} SELECT key, layer_seq, xor(g1, bit_xor(d1) OVER w) AS first, xor(g2, bit_xor(d2) OVER w) AS second FROM l JOIN g USING (key) WINDOW w AS (PARTITION BY key ORDER BY layer_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def xor_read_through(spark, sf):
    return layers.read_through(*order_layers(spark, sf)).select("key", "layer_seq", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(1)).alias("second"))


@query(f"WITH {LAYERS}, x AS (SELECT key, bit_xor(d1) AS d1, bit_xor(d2) AS d2 FROM l GROUP BY key) SELECT g.key, CAST(coalesce(bit_count(d1) + bit_count(d2), 0) AS BIGINT) AS changed FROM g LEFT JOIN x USING (key)")
def layer_changed_bits(spark, sf):
    return layers.changed_bits(*order_layers(spark, sf))


@query(f"WITH {LAYERS} SELECT g.key, xor(g1, coalesce(d1, 0)) AS first, xor(g2, coalesce(d2, 0)) AS second FROM g LEFT JOIN (SELECT * FROM l WHERE layer_seq = 0) USING (key)")
def collapse_first_layer(spark, sf):
    return layers.collapse_layer(*order_layers(spark, sf), 0)[0].select("key", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(1)).alias("second"))


@query(f"WITH {LAYERS}, x AS (SELECT key, bit_xor(d1) AS d1, bit_xor(d2) AS d2 FROM l GROUP BY key) SELECT g.key, xor(g1, coalesce(d1, 0)) AS first, xor(g2, coalesce(d2, 0)) AS second, CAST(0 AS BIGINT) AS depth FROM g LEFT JOIN x USING (key)")
def collapsed_layers(spark, sf):
    """All layers written to the ground, which is read through what is left."""
    return layers.read_all(*layers.collapse_all(*order_layers(spark, sf))).select("key", F.get("value", F.lit(0)).alias("first"), F.get("value", F.lit(1)).alias("second"), "depth")


@query(f"WITH {LAYERS}, n AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT g.key, coalesce(n, 0) AS top, coalesce(n, 0) + 1 AS depth, true AS clean FROM g LEFT JOIN n USING (key)")
def pushed_layers(spark, sf):
    """A clean layer on top of every order's."""
    ground, own = order_layers(spark, sf)
    pushed = layers.push(own, ground)
    top = pushed.groupBy("key").agg(F.max("layer_seq").alias("top"), F.count("*").alias("depth"), F.max_by("delta", "layer_seq").alias("delta"))
    return top.select("key", "top", "depth", F.forall("delta", lambda x: x == 0).alias("clean"))


# ---- overlays, delta cubes and permutations on the supplier bytes


def _moved(perm: str) -> str:
    return f"CAST(sum(({perm} + 1) * a) AS BIGINT)"


@query(f"""WITH {REGIONS} SELECT id, CAST(sum((j + 1) * xor(a, b)) AS BIGINT) AS read_xor, CAST(sum((j + 1) * ((a + b) % 256)) AS BIGINT) AS read_add, CAST(sum((j + 1) * greatest(-128, least(127, a - 128 + b - 128))) AS BIGINT) AS read_i8,
 CAST(sum((j + 1) * (((a - 128) - (b - 128) + 128 + 512) % 256 - 128)) AS BIGINT) AS delta_sub, CAST(sum((j + 1) * b) AS BIGINT) AS recovered FROM f GROUP BY id""")
def overlays_and_deltas(spark, sf):
    r = regions(spark, sf)
    i8 = lambda c: F.transform(F.col(c), lambda x: x - 128)
    return r.select("id", checksum(layers.overlay_read("a", "b", "xor")).alias("read_xor"), checksum(layers.overlay_read("a", "b", "add")).alias("read_add"), checksum(layers.overlay_read(i8("a"), i8("b"), "add_i8")).alias("read_i8"), checksum(V.wrapping_sub_i8(i8("a"), i8("b"))).alias("delta_sub"), checksum(V.xor(V.xor("a", "b"), "a")).alias("recovered"))


@query(f"""WITH {REGIONS}, p AS (SELECT *, j // 256 AS x, j // 32 % 8 AS y, j % 32 AS z FROM f)
SELECT id, {_moved('(x + 3) % 8 * 256 + y * 32 + z')} AS rotated_x, {_moved('x * 256 + (y + 5) % 8 * 32 + z')} AS rotated_y, {_moved('x * 256 + y * 32 + (z + 9) % 32')} AS rotated_z, {_moved('y * 256 + z % 8 * 32 + 4 * x + z // 8')} AS turned, {_moved('j')} AS back, {_moved('(x + 3) % 8 * 256 + y * 32 + (z + 9) % 32')} AS composed FROM p GROUP BY id""")
def spatial_transforms(spark, sf):
    r = regions(spark, sf)
    x, y, z, d = holograph.rotation("x", 3), holograph.rotation("y", 5), holograph.rotation("z", 9), holograph.diagonal()
    return r.select("id", checksum(holograph.move("a", x)).alias("rotated_x"), checksum(holograph.move("a", y)).alias("rotated_y"), checksum(holograph.move("a", z)).alias("rotated_z"), checksum(holograph.move("a", d)).alias("turned"), checksum(holograph.move(holograph.move("a", d), holograph.inverse(d))).alias("back"), checksum(holograph.move("a", holograph.compose(x, z))).alias("composed"))


@query(f"""WITH {REGIONS} SELECT id, CAST(sum((j + 1) * a) AS BIGINT) AS once, true AS first_back, CAST(1 AS BIGINT) AS left_over, CAST(sum((j + 1) * b) AS BIGINT) AS twice, true AS second_back, false AS third_back, CAST(0 AS BIGINT) AS discarded, true AS clean FROM f GROUP BY id""")
def overlay_history(spark, sf):
    """Two snapshots, of b and then a; three times back, of which the last finds none."""
    r = regions(spark, sf).withColumnRenamed("id", "overlay_id")
    own = lambda c: r.select("overlay_id", F.col(c).alias("buffer"))
    none = own("a").select("overlay_id", F.lit(0).cast("long").alias("depth"), "buffer").where("false")
    held = layers.snapshot(own("a"), layers.snapshot(own("b"), none))
    one, rest = layers.rewind(layers.discard(own("a")), held)
    left = rest.groupBy("overlay_id").agg(F.count("*").alias("left_over"))
    two, rest = layers.rewind(one.drop("rewound"), rest)
    three, _ = layers.rewind(two.drop("rewound"), rest)
    gone = layers.discard(three)
    of = lambda f, value, back: f.select("overlay_id", checksum("buffer").alias(value), F.col("rewound").alias(back))
    whole = of(one, "once", "first_back").join(left, "overlay_id").join(of(two, "twice", "second_back"), "overlay_id").join(three.select("overlay_id", F.col("rewound").alias("third_back")), "overlay_id")
    whole = whole.join(gone.select("overlay_id", checksum("buffer").alias("discarded"), F.forall("buffer", lambda x: x == 0).alias("clean")), "overlay_id")
    return whole.withColumnRenamed("overlay_id", "id")


@query(f"""WITH {REGIONS} SELECT id, CAST(sum((j + 1) * xor(a, b)) AS BIGINT) AS xored, CAST(sum((j + 1) * ((a + b) % 256)) AS BIGINT) AS added, CAST(sum((j + 1) * greatest(-128, least(127, a - 128 + b - 128))) AS BIGINT) AS added_i8, CAST(0 AS BIGINT) AS cleared FROM f GROUP BY id""")
def flushed_overlays(spark, sf):
    r = regions(spark, sf).withColumnRenamed("id", "overlay_id")
    signed = lambda c: F.transform(F.col(c), lambda x: x - 128)
    out = None
    for how, name, value, buffer in (("xor", "xored", F.col("a"), F.col("b")), ("add", "added", F.col("a"), F.col("b")), ("add_i8", "added_i8", signed("a"), signed("b"))):
        new, cleared = layers.flush(r.select("overlay_id", value.alias("value")), r.select("overlay_id", buffer.alias("buffer")), how)
        part = new.select("overlay_id", checksum("value").alias(name))
        out = part if out is None else out.join(part, "overlay_id")
    return out.join(cleared.select("overlay_id", checksum("buffer").alias("cleared")), "overlay_id").withColumnRenamed("overlay_id", "id")


# ---- co-occurrence: types of event of each user's day


def observations(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("window_id"), F.col("event_type").alias("item"))


OBSERVED = "o AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || strftime(ts, '%Y-%m-%d') AS w, event_type AS item FROM events), t AS (SELECT item, CAST(count(*) AS DOUBLE) AS total FROM o GROUP BY item), c AS (SELECT a.item AS i, b.item AS j, CAST(count(*) AS DOUBLE) AS n FROM o a JOIN o b USING (w) WHERE a.item < b.item GROUP BY 1, 2)"


@query(f"WITH {OBSERVED} SELECT * FROM c")
def cooccurrence(spark, sf):
    return learn.cooccurrence(observations(spark, sf))


@query(f"WITH {OBSERVED} SELECT i, j, round(n / sqrt(a.total * b.total), 6) AS norm FROM c JOIN t a ON a.item = i JOIN t b ON b.item = j")
def cooccurrence_norm(spark, sf):
    o = observations(spark, sf)
    return learn.normalized(learn.cooccurrence(o), learn.totals(o)).withColumn("norm", F.round("norm", 6))


@query(f"WITH {OBSERVED} SELECT count(*) FILTER (total >= 5) >= 8 AS ready FROM t")
def ready_for_axes(spark, sf):
    return learn.ready(learn.totals(observations(spark, sf)))


def numbered(spark, sf) -> tuple[DataFrame, DataFrame, int]:
    """Co-occurrence of users who did something on the same day at one hour, by number; and totals."""
    o = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH").alias("window_id"), (F.col("user_id") % 24).cast("int").alias("item"))
    return learn.cooccurrence(o), learn.totals(o), 24


@query(oracles.principal_axes(24))
def principal_axes(spark, sf):
    pairs, totals, k = numbered(spark, sf)
    axes = learn.crystallize(pairs, totals, k)
    rows = spark.createDataFrame([(i, *map(float, c), int(f)) for i, (c, f) in enumerate(zip(axes.coords, learn.assign_frequencies(axes.coords), strict=True))], "item int, x double, y double, z double, freq int")
    return rows.select("item", *[F.round(c, 3).alias(c) for c in "xyz"], "freq")


@query()
def axis_update(spark, sf):
    pairs, totals, k = numbered(spark, sf)
    old = learn.crystallize(pairs, totals, k)
    norm = learn.matrix_of(learn.normalized(pairs, totals), k)
    _, moves = learn.update_axes(old, np.roll(norm, (1, 1), (0, 1)), 0.5)
    return spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, a, b in moves], "item int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")


@query()
def migrated_containers(spark, sf):
    pairs, totals, k = numbered(spark, sf)
    axes = learn.crystallize(pairs, totals, k)
    migrate = C.by_row(lambda c: learn.migrate(C.i8(c), axes, 2.0)[0].tobytes(), "binary")
    return carrier_containers(spark, sf).select("container_id", F.hex(F.md5(migrate(F.col("container"))).cast("binary")).alias("digest"))


# ---- graph: suppliers, nations and regions


def trade_graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities, edges and integer templates of 32 elements."""
    r, n, s = (table(spark, sf, t) for t in ("region", "nation", "supplier"))
    entities = r.select(F.col("r_regionkey").cast("long").alias("index"), F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("Civic").alias("entity_type"))
    entities = entities.unionByName(n.select((100 + F.col("n_nationkey")).cast("long").alias("index"), F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Stakeholder").alias("entity_type")))
    entities = entities.unionByName(s.select((1000 + F.col("s_suppkey")).alias("index"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("System").alias("entity_type")))
    edges = n.select((100 + F.col("n_nationkey")).cast("long").alias("seq"), F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.concat(F.lit("r"), "n_regionkey").alias("target_id"), F.lit("Place").alias("edge_type"), F.lit(None).cast("string").alias("label"))
    edges = edges.unionByName(s.select((1000 + F.col("s_suppkey")).alias("seq"), F.concat(F.lit("s"), "s_suppkey").alias("source_id"), F.concat(F.lit("n"), "s_nationkey").alias("target_id"), F.lit("Deploys").alias("edge_type"), F.lit(None).cast("string").alias("label")))
    vecs = entities.select("index", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: ((F.col("index") * 31 + j * j * 17 + F.col("index") * j * 5) % 7 - 3).cast("int")).alias("vec"))
    return entities, edges, vecs


BASE = ("signed", 7)
GRAPH = """e AS (SELECT CAST(r_regionkey AS BIGINT) AS idx, 'r' || r_regionkey AS id, r_name AS name, 'Civic' AS type FROM region UNION ALL SELECT 100 + n_nationkey, 'n' || n_nationkey, n_name, 'Stakeholder' FROM nation UNION ALL SELECT 1000 + s_suppkey, 's' || s_suppkey, s_name, 'System' FROM supplier),
g AS (SELECT CAST(100 + n_nationkey AS BIGINT) AS i, CAST(n_regionkey AS BIGINT) AS j, 'Place' AS type, 0.6 AS amp FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey, 'Deploys', 0.9 FROM supplier),
t AS (SELECT idx, p, (idx * 31 + p * p * 17 + idx * p * 5) % 7 - 3 AS x FROM e, (SELECT unnest(range(0, 32)) AS p)),
k AS (SELECT a.p AS p, CAST(greatest(-3, least(3, round(round(sum(CAST(amp AS DOUBLE) * greatest(-3, least(3, a.x + b.x))), 6)))) AS BIGINT) AS c FROM g JOIN t a ON a.idx = i JOIN t b ON b.idx = j AND b.p = a.p GROUP BY a.p),
probe AS (SELECT a.idx AS i, b.idx AS j, sum(greatest(-3, least(3, a.x + b.x)) * c) / greatest(sqrt(CAST(sum(greatest(-3, least(3, a.x + b.x)) * greatest(-3, least(3, a.x + b.x))) AS DOUBLE)) * sqrt(CAST(sum(c * c) AS DOUBLE)), 1e-10) AS s FROM t a JOIN t b ON a.p = b.p JOIN k ON k.p = a.p GROUP BY a.idx, b.idx)"""


def stored_edges(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, list[float]]:
    entities, edges, vecs = trade_graph(spark, sf)
    return entities, edges, vecs, [float(x) for x in graph.encode(entities, edges, vecs, BASE).first().container]


@query("SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS neighbor FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier")
def graph_neighbors(spark, sf):
    entities, edges, _ = trade_graph(spark, sf)
    return graph.neighbors(entities, edges).select("id", "neighbor")


@query(f"WITH {GRAPH} SELECT p AS pos, c AS value FROM k")
def encoded_edges(spark, sf):
    entities, edges, vecs = trade_graph(spark, sf)
    return graph.encode(entities, edges, vecs, BASE).select(F.posexplode("container").alias("pos", "value")).select(F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"))


@query(f"""WITH {GRAPH}, n AS (SELECT probe.i, probe.j, s FROM probe WHERE probe.i < probe.j AND NOT EXISTS (SELECT 1 FROM g WHERE least(g.i, g.j) = probe.i AND greatest(g.i, g.j) = probe.j))
SELECT i AS entity_a, j AS entity_b, a.type AS type_a, b.type AS type_b, round(s, 6) AS ghost_signal FROM (SELECT * FROM n ORDER BY abs(round(s, 9)) DESC, i, j LIMIT 50) JOIN e a ON a.idx = i JOIN e b ON b.idx = j""")
def nonedge_pairs_topk(spark, sf):
    entities, edges, vecs, container = stored_edges(spark, sf)
    best = graph.all_ghosts(entities, edges, vecs, BASE, {"ghost_signal": container}, "ghost_signal", 50, digits=9)
    return best.select("entity_a", "entity_b", "type_a", "type_b", F.round("ghost_signal", 6).alias("ghost_signal"))


@query(f"""WITH {GRAPH}, n AS (SELECT probe.i, probe.j, s FROM probe WHERE probe.i < probe.j AND NOT EXISTS (SELECT 1 FROM g WHERE least(g.i, g.j) = probe.i AND greatest(g.i, g.j) = probe.j))
SELECT a.type || '<->' || b.type AS type_pair, count(*) AS n, round(avg(abs(s)), 6) AS mean_ghost, round(avg(abs(s)), 6) AS mean_direct FROM n JOIN e a ON a.idx = i JOIN e b ON b.idx = j GROUP BY 1""")
def ghost_type_summary(spark, sf):
    entities, edges, vecs, container = stored_edges(spark, sf)
    found = graph.all_types(entities, edges, vecs, BASE, {"ghost_signal": container, "direct_strength": container})
    return found.select("type_pair", "n", F.round("mean_ghost", 6).alias("mean_ghost"), F.round("mean_direct", 6).alias("mean_direct"))


@query(f"""WITH {GRAPH}, n AS (SELECT probe.i, probe.j, s FROM probe JOIN e a ON a.idx = probe.i JOIN e b ON b.idx = probe.j WHERE a.type = 'System' AND b.type = 'Stakeholder' AND NOT EXISTS (SELECT 1 FROM g WHERE g.i = probe.i AND g.j = probe.j))
SELECT i AS entity_a, j AS entity_b, round(s, 6) AS signed_strength FROM n""")
def dual_ghost_pairs(spark, sf):
    entities, edges, vecs, container = stored_edges(spark, sf)
    system, nation = F.col("entity_type") == "System", F.col("entity_type") == "Stakeholder"
    return graph.all_ghosts(entities, edges, vecs, BASE, {"signed_strength": container}, "signed_strength", None, system, nation).select("entity_a", "entity_b", F.round("signed_strength", 6).alias("signed_strength"))


@query(f"""WITH {GRAPH}, s AS (SELECT g.type, probe.s FROM g JOIN probe ON probe.i = g.i AND probe.j = g.j)
SELECT coalesce(type, '*') AS edge_type, count(*) AS n, round(avg(s), 6) AS mean_direct, round(min(s), 6) AS min_direct, round(max(s), 6) AS max_direct FROM s GROUP BY ROLLUP (type)""")
def edge_strength_by_type(spark, sf):
    entities, edges, vecs, container = stored_edges(spark, sf)
    found = graph.known_strength(entities, edges, vecs, BASE, {"direct": container})
    return found.select("edge_type", "n", *[F.round(f"{m}_direct", 6).alias(f"{m}_direct") for m in ("mean", "min", "max")])


@query()
def organic_residual(spark, sf):
    entities, edges, vecs, container = stored_edges(spark, sf)
    rest, found = graph.residual(entities, edges, vecs, BASE, container)
    return spark.createDataFrame([(int(i), float(x)) for i, x in enumerate(rest)], "pos int, residual double").withColumn("n_coefficients", F.lit(len(found)))


def part_axes(spark, sf) -> DataFrame:
    none = F.lit(None).cast("string")
    axes = F.struct(F.when(F.col("p_size") > 25, F.col("p_type")).alias("current_status"), F.regexp_replace("p_name", " ", " , ").alias("system_type"), none.alias("ml_task"), none.alias("military_use"), none.alias("civic_use"), F.col("p_brand").alias("purpose"), none.alias("capacity"), none.alias("output"), none.alias("impact"), none.alias("stakeholder_type"), F.concat(F.lit(" ,"), "p_type", F.lit(",,")).alias("airo_type"), none.alias("person_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("System").alias("entity_type"), axes.alias("axes"))


AXES = """a AS (SELECT p_partkey AS index, list_concat(CASE WHEN p_size > 25 THEN ['status:' || p_type] ELSE [] END, list_transform(string_split(p_name, ' '), lambda x: 'type:' || x), ['purpose:' || p_brand], ['airo:' || p_type]) AS t FROM part),
x AS (SELECT index, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM a), r AS (SELECT token, row_number() OVER (ORDER BY m) - 1 AS rank FROM (SELECT token, min({'i': index, 'p': pos}) AS m FROM x GROUP BY token))"""


@query(f"WITH {AXES} SELECT x.index, pos, token, rank FROM x JOIN r USING (token)")
def axis_tokens(spark, sf):
    return graph.tokens(part_axes(spark, sf)).select("index", F.col("pos").cast("long").alias("pos"), "token", "rank")


@query(oracles.entity_templates(AXES))
def entity_templates(spark, sf):
    return graph.templates(part_axes(spark, sf), 64, BASE, 0.05).select("index", text("vec").alias("vec"))


# ---- ontology readback


@query(oracles.CONCEPT_READBACK)
def concept_readback(spark, sf):
    return ghosts.verdicts(ghosts.readback(spark, (4096,))).select("scenario", "index", "id", "domain", "tau", "was_stored", "original_amplitude", F.round("readback", 6).alias("readback"), "is_ghost", "verdict")


@query(oracles.GHOST_MATRIX)
def ghost_matrix(spark, sf):
    return ghosts.matrix(spark, 4096).select("stored", *[F.round(d, 6).alias(d) for d in ghosts.DOMAINS])


@query(oracles.GHOST_DIMENSIONALITY)
def ghost_dimensionality(spark, sf):
    return ghosts.counts(ghosts.readback(spark, (256, 512, 1024, 2048, 4096, 8192, 16384))).withColumn("max_ghost", F.round("max_ghost", 6))


def label_means(spark, sf) -> DataFrame:
    return phase.bundle_mean(vectors(spark, sf), "label", "wr").select(F.col("label").alias("index"), (F.col("label") * 23 % 256).alias("tau"), F.col("bundle").alias("vec"))


@query(f"""WITH {VECTORS}, x AS (SELECT label, i, CAST(sum(x) // count(*) AS DOUBLE) AS b FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(wr) AS x FROM v) GROUP BY label, i),
c AS (SELECT a.label AS i, b.label AS j, least(abs(a.label * 23 % 256 - b.label * 23 % 256) // 8, 15) AS bucket, corr(a.b, b.b) AS r FROM x a JOIN x b ON a.i = b.i AND a.label < b.label GROUP BY a.label, b.label)
SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(r), 6) AS avg_corr, round(max(r), 6) AS max_corr, count(*) AS n, CASE WHEN avg(r) > 0.3 THEN 'strong link' WHEN avg(r) > 0.1 THEN 'weak link' WHEN avg(r) > 0.02 THEN 'faint' ELSE 'orthogonal' END AS label FROM c GROUP BY bucket""")
def tau_bucket_corr(spark, sf):
    return ghosts.tau_topology(label_means(spark, sf)).select("bucket", F.round("avg_corr", 6).alias("avg_corr"), F.round("max_corr", 6).alias("max_corr"), "n", "label")


@query(oracles.TAU_TOPOLOGY)
def tau_topology(spark, sf):
    return ghosts.tau_topology(ghosts.template_table(spark, 4096)).select("bucket", F.round("avg_corr", 6).alias("avg_corr"), F.round("max_corr", 6).alias("max_corr"), "n", "label")


# ---- templates and sums of them: classes are labels, entities are vectors of neighbouring ids


def template_table(spark, sf) -> DataFrame:
    """One template a label: its mean bytes less 96, divided by 16, as integers."""
    means = phase.bundle_mean(vectors(spark, sf), "label", "wr")
    return means.select(F.col("label").cast("long").alias("concept_id"), F.lit(0).alias("axis"), F.transform("bundle", lambda x: (F.floor((x - 96) / 4) % 7 - 3).cast("int")).alias("vec"))


TEMPLATES = f"{VECTORS}, tm AS (SELECT label AS concept_id, i, ((CAST(floor((sum(x) // count(*) - 96) / 4.0) AS BIGINT) % 7) - 3) AS t FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(wr) AS x FROM v) GROUP BY label, i)"


def coefficient_table(spark, sf) -> DataFrame:
    v = vectors(spark, sf)
    return v.groupBy((F.col("vec_id") % 17).alias("entity_id"), F.col("label").cast("long").alias("concept_id")).agg(F.count("*").alias("n")).select("entity_id", "concept_id", ((F.col("n") % 5 - 2) * 0.25).alias("coefficient"))


COEFFICIENTS = "cf AS (SELECT vec_id % 17 AS entity_id, label AS concept_id, (count(*) % 5 - 2) * 0.25::DOUBLE AS coefficient FROM embeddings GROUP BY 1, 2)"


@query(f"WITH {TEMPLATES} SELECT CAST(a.concept_id AS BIGINT) AS i, CAST(b.concept_id AS BIGINT) AS k, CAST(sum(a.t * b.t) AS DOUBLE) AS dot FROM tm a JOIN tm b ON a.i = b.i AND a.concept_id <= b.concept_id GROUP BY 1, 2")
def gram_matrix(spark, sf):
    return oracle.gram(template_table(spark, sf)).select("i", "k", "dot")


@query(f"WITH {TEMPLATES}, {COEFFICIENTS} SELECT entity_id, i - 1 AS pos, CAST(greatest(-3, least(3, round(sum(coefficient * t)))) AS BIGINT) AS value FROM cf JOIN tm USING (concept_id) GROUP BY entity_id, i")
def materialize_warm(spark, sf):
    warm = oracle.materialize(coefficient_table(spark, sf), template_table(spark, sf), BASE)
    return warm.select("entity_id", F.posexplode("vec").alias("pos", "value")).select("entity_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"))


@query(f"WITH {TEMPLATES}, {COEFFICIENTS} SELECT entity_id, i - 1 AS pos, round(sum(coefficient * t), 6) AS value FROM cf JOIN tm USING (concept_id) GROUP BY entity_id, i")
def materialize_hot(spark, sf):
    hot = oracle.materialize(coefficient_table(spark, sf), template_table(spark, sf))
    return hot.select("entity_id", F.posexplode("vec").alias("pos", "value")).select("entity_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"""WITH {TEMPLATES}, {COEFFICIENTS}, w AS (SELECT entity_id, i, CAST(greatest(-3, least(3, round(sum(coefficient * t)))) AS BIGINT) AS x FROM cf JOIN tm USING (concept_id) GROUP BY entity_id, i), n AS (SELECT entity_id, count(*) AS k FROM cf GROUP BY entity_id),
s AS (SELECT entity_id, greatest(count(*) FILTER (abs(x) >= 3) / 64.0, sum(x * x) / greatest(any_value(k) * 64 * 0.5, 1.0) - 1, 1 - count(*) FILTER (x = 0) / (64 / 7.0), 0.0) AS o FROM w JOIN n USING (entity_id) GROUP BY entity_id)
SELECT entity_id, round(o, 6) AS overexposure, CASE WHEN o < 0.5 THEN 'None' WHEN o < 0.8 THEN 'SoftFlush' WHEN o < 1.0 THEN 'HardFlush' ELSE 'Emergency' END AS action FROM s""")
def overexposure(spark, sf):
    c = coefficient_table(spark, sf)
    warm = oracle.materialize(c, template_table(spark, sf), BASE)
    return oracle.overexposure(warm, oracle.cold_size(c).select("entity_id", "k"), BASE).withColumn("overexposure", F.round("overexposure", 6))


@query(f"WITH {COEFFICIENTS} SELECT entity_id, count(*) AS k, 8 * count(*) AS bytes FROM cf GROUP BY entity_id")
def cold_size(spark, sf):
    return oracle.cold_size(coefficient_table(spark, sf))


@query(oracles.surgical_cool(TEMPLATES, COEFFICIENTS))
def surgical_cool(spark, sf):
    c, t = coefficient_table(spark, sf), template_table(spark, sf)
    return oracle.cool(oracle.materialize(c, t), c, t).select("entity_id", "concept_id", F.round("coefficient", 4).alias("coefficient"))


@query(oracles.warm_writes(TEMPLATES, COEFFICIENTS))
def warm_writes_in_order(spark, sf):
    c = coefficient_table(spark, sf).withColumn("seq", F.col("concept_id"))
    return oracle.add_in_order(c, template_table(spark, sf), BASE).select("entity_id", text("vec").alias("vec"))


@query(f"WITH {VECTORS} SELECT vec_id, {joined('list_transform(range(0, 20), lambda i: CAST(greatest(-3, least(3, round(list_sum(list_transform(ph[i * 3 + 1 : i * 3 + 3], lambda x: x - 128)) / 3.0::DOUBLE))) AS BIGINT))')} AS down, {joined('list_transform(range(0, 128), lambda j: CAST((CASE WHEN j % 2 = 0 THEN ph[j // 2 + 1] ELSE (ph[j // 2 + 1] + ph[least(j // 2 + 2, 64)]) / 2.0 END) * 2 AS BIGINT))')} AS up_twice FROM v")
def resampled(spark, sf):
    v = vectors(spark, sf)
    down = V.downsample(F.transform("ph", lambda x: (x - 128).cast("double")), 20, -3, 3)
    return v.select("vec_id", text(down).alias("down"), text(F.transform(V.upsample("ph", 128), lambda x: (x * 2).cast("long"))).alias("up_twice"))


@query(oracles.hebbian_templates(TEMPLATES, COEFFICIENTS))
def hebbian_templates(spark, sf):
    t = template_table(spark, sf)
    one = lambda k, name: F.broadcast(t.where(F.col("concept_id") == k).select(F.col("vec").alias(name)))  # noqa: E731  one row
    warm = oracle.materialize(coefficient_table(spark, sf), t, BASE).crossJoin(one(0, "a")).crossJoin(one(1, "b"))
    learnt = oracle.hebbian(warm, F.col("a"), F.col("b"), 0.375, BASE)
    return learnt.select("entity_id", F.posexplode("vec").alias("pos", "value")).select("entity_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"))


# ---- recogniser


def classes(spark, sf) -> DataFrame:
    means = phase.bundle_mean(vectors(spark, sf).withColumn("x", F.transform("ph", lambda x: x - 128 + 64)), "label", "x")
    return means.select(F.col("label").alias("class_idx"), (F.col("label") + 100).cast("long").alias("class_id"), F.transform("bundle", lambda x: x - 64).alias("template"))


def recognised(spark, sf, method: str) -> DataFrame:
    asked = vectors(spark, sf).select(F.col("vec_id").alias("query_id"), F.transform("ph", lambda x: x - 128).alias("vec"))
    found = recognise.recognise(asked, recognise.model(classes(spark, sf), 512), method)
    return found.select("query_id", "best_class", "best_class_id", F.round(F.col("best_score").cast("double"), 4).alias("best_score"), "is_novel", F.round(F.col("residual_energy").cast("double"), 4).alias("residual_energy"), "method")


@query(oracles.recogniser(VECTORS, "hamming"))
def recognize_hamming(spark, sf):
    return recognised(spark, sf, "hamming")


@query(oracles.recogniser(VECTORS, "projection"))
def recognize_projection(spark, sf):
    return recognised(spark, sf, "projection")


@query(oracles.recogniser(VECTORS, "two_stage"))
def recognize_two_stage(spark, sf):
    return recognised(spark, sf, "two_stage")


@query(oracles.learnt(VECTORS))
def learnt_classes(spark, sf):
    examples = vectors(spark, sf).select(F.col("label").alias("class_idx"), F.transform("ph", lambda x: x - 128).alias("vec"))
    return recognise.learn(classes(spark, sf), examples).select("class_idx", "class_id", text("template").alias("template"))


@query(oracles.lsh())
def lsh_fingerprints(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return recognise.fingerprints(rows, "embedding", 64, 512).select("vec_id", F.hex("fp").alias("fp"))


@query()
def recognition_sweep(spark, sf):
    return recognise.sweep(spark)


# ---- recovery sweeps


@query()
def recovery_sweep(spark, sf):
    return sweep.report(sweep.run(sweep.grid(spark, repetitions=2)))


@query()
def recovery_report(spark, sf):
    return records.sweep_report(sweep.run(sweep.grid(spark, dims=(1024,), bundles=(3, 8), axes=(1, 2), depths=(1, 2))))


# ---- carriers and wavelets: one container an embedding


def carrier_containers(spark, sf) -> DataFrame:
    """Each vector's first sixteen values as phases of the sixteen carriers."""

    def encode(vectors: pd.Series) -> pd.Series:
        phases = np.stack([np.asarray(v[:16], np.float64) for v in vectors]) * 3.0
        out = np.zeros((len(phases), K.SIZE), np.int8)
        for f in range(16):
            out = K.add_i8(out, np.stack([K.carrier_samples(f, p, 3.0) for p in phases[:, f]]))
        return pd.Series([row.tobytes() for row in out], dtype=object)

    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("container_id"), C.by_batch(encode, "binary")(F.col("embedding")).alias("container"))


@query(oracles.CARRIER_SPECTRUM)
def carrier_spectrum(spark, sf):
    return carrier_containers(spark, sf).select("container_id", F.posexplode(C.carrier_spectrum(F.col("container"))).alias("f", "amplitude")).withColumn("amplitude", F.round(F.col("amplitude").cast("double"), 3))


@query(oracles.SPECTRAL_DISTANCES)
def spectral_distances(spark, sf):
    a = carrier_containers(spark, sf).select("container_id", C.carrier_spectrum(F.col("container")).alias("a"))
    b = a.select((F.col("container_id") - 1).alias("container_id"), F.col("a").alias("b"))
    return a.join(b, "container_id").select("container_id", F.round(V.l1_float("a", "b"), 3).alias("distance"))


@query(oracles.CARRIER_ROUNDTRIP)
def carrier_roundtrip(spark, sf):
    encoded = carrier_containers(spark, sf).withColumn("container", C.carrier_encode(F.lit(bytes(2048)), (F.col("container_id") % 16).cast("int"), F.lit(1.5), F.lit(7.0)))
    return encoded.select("container_id", C.carrier_decode(F.col("container"), F.col("container_id") % 16).alias("r")).select("container_id", F.round(F.col("r.phase").cast("double"), 3).alias("phase"), F.round(F.col("r.amplitude").cast("double"), 3).alias("amplitude"))


@query(oracles.CARRIER_BUNDLES)
def carrier_bundles(spark, sf):
    rows = carrier_containers(spark, sf).select((F.col("container_id") % 20).alias("container_id"), F.col("container_id").alias("seq"), "container")
    return holograph.bundle_in_order(rows).select("container_id", F.md5("bundle").alias("digest"))


def writes(spark, sf) -> DataFrame:
    ids = table(spark, sf, "embeddings").select("vec_id", "embedding")
    # in single precision throughout: beside an integer a float becomes a double
    single = lambda n: F.lit(float(n)).cast("float")
    place = lambda k, n: F.floor((F.get("embedding", F.lit(k)) + single(1)) * single(97)).cast("int") % n
    freq = F.element_at(F.array(*map(F.lit, K.FREQUENCIES[:7])), (F.col("vec_id") % 7 + 1).cast("int")).cast("double")
    return ids.select((F.col("vec_id") % 25).alias("container_id"), F.col("vec_id").alias("seq"), F.lit(1.5).alias("sigma"), place(0, 8).alias("x"), place(1, 8).alias("y"), place(2, 32).alias("z"), freq.alias("freq"), F.get("embedding", F.lit(3)).cast("double").alias("phase"), F.lit(20.0).alias("amplitude"))


def wavelet_containers(spark, sf) -> DataFrame:
    empty = writes(spark, sf).select("container_id").distinct().withColumn("container", F.lit(bytes(2048)))
    return holograph.write_in_order(empty, writes(spark, sf))


@query(oracles.WAVELET_READBACK)
def wavelet_readback(spark, sf):
    w = writes(spark, sf).join(wavelet_containers(spark, sf), "container_id")
    return w.select("seq", C.gabor_read(F.col("container"), F.col("sigma"), F.col("x"), F.col("y"), F.col("z"), F.col("freq")).alias("r")).select("seq", F.round(F.col("r.phase").cast("double"), 2).alias("phase"), F.round(F.col("r.amplitude").cast("double"), 2).alias("amplitude"))


@query(oracles.WAVELET_PEAKS)
def wavelet_peaks(spark, sf):
    return holograph.spectral_table(wavelet_containers(spark, sf), 1.5, 15.0).select("container_id", "x", "y", "z", "f", F.round(F.col("amp").cast("double"), 2).alias("amp"))


def _known() -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z"), F.lit(f).alias("freq")) for x, y, z, f in ((4, 4, 16, 3.0), (2, 3, 8, 5.0))])


@query()
def wavelet_cleaning(spark, sf):
    c = F.col("container")
    rows = wavelet_containers(spark, sf)
    clean = C.clean_if_needed(c, _known(), F.lit(1.5), F.lit(50.0), F.lit(2.0))
    return rows.select("container_id", F.round(C.residual_energy(c, _known(), F.lit(1.5)), 1).alias("energy"), F.md5(clean).alias("clean"), C.adapt_sigma(c, F.lit(1.5), F.lit(4), F.lit(4), F.lit(16), F.lit(3.0), F.lit(1.5), F.lit(0.1), F.lit(2.0)).alias("sigma"))


@query(oracles.ARCHETYPES)
def archetype_detection(spark, sf):
    rows = wavelet_containers(spark, sf).withColumn("found", C.archetypes(F.col("container"), F.lit(1.5), F.lit(8.0)))
    return rows.select("container_id", F.size("found").alias("n"), F.md5(C.crystallize(F.col("container"), F.col("found"), F.lit(2.0), F.lit(1.0))).alias("crystal"))


@query(oracles.HEBBIAN)
def hebbian_overlays(spark, sf):
    rows = wavelet_containers(spark, sf)
    update = C.by_row(lambda o: K.add_i8(C.i8(o), K.hebbian((4, 4, 16, 3.0), (5, 4, 15, 3.0), 2.0, 0.5)).tobytes(), "binary")
    return rows.select("container_id", F.md5(update(F.col("container"))).alias("digest"))


@query(oracles.BATCH)
def batch_writes(spark, sf):
    fields = ("sigma", "x", "y", "z", "freq", "amplitude", "phase")
    lists = writes(spark, sf).groupBy("container_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("w"))
    return lists.select("container_id", F.md5(C.batch_flush(F.lit(bytes(2048)), F.col("w"))).alias("digest"))


@query(oracles.POINTS)
def points_5d(spark, sf):
    point = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", C.project_5d(point, 42).alias("phase"))
    rows = rows.select("vec_id", F.md5("phase").alias("digest"), C.recover_5d(F.col("phase"), 42).alias("point"))
    return rows.select("vec_id", "digest", *[F.round(F.get("point", F.lit(d)), 4).alias(f"p{d}") for d in range(5)])


# ---- records


@query("""WITH r AS (SELECT i AS row_id, i AS v FROM (SELECT unnest(range(0, 100)) AS i) UNION ALL SELECT 100 + i, i FROM (SELECT unnest(range(0, 20)) AS i))
SELECT row_id, upper(printf('%02x%02x%02x%02x', CAST(v % 256 AS INTEGER), CAST((v + 3) % 256 AS INTEGER), CAST((v + 6) % 256 AS INTEGER), CAST((v + 9) % 256 AS INTEGER))) AS firsts, CAST(8192 AS INTEGER) AS bytes FROM r""")
def record_tables(spark, sf):
    """A table written, appended to and read, by way of Arrow."""
    path = records.scratch(spark)
    records.write(records.filled(spark, 100, 3), path)
    records.append(records.from_arrow(spark, records.to_arrow(records.filled(spark, 20, 3))), path)
    first = [F.hex(F.substring(c, 2048, 1)) for c in records.CHANNELS]
    return records.read(spark, path).select("row_id", F.concat(*first).alias("firsts"), F.octet_length(records.pack()).alias("bytes"))


@query("SELECT s_suppkey AS row_id, 8192 AS bytes, upper(to_hex(s_suppkey % 256)) AS meta_byte, 'Carrier' AS mode FROM supplier")
def record_codec(spark, sf):
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"))
    fill = lambda k: F.unhex(F.repeat(F.lpad(F.hex(F.pmod(F.col("row_id") + k, F.lit(256))), 2, "0"), records.SIZE))
    rows = records.checked(keys.select("row_id", *[fill(i).alias(c) for i, c in enumerate(records.CHANNELS)])).withColumn("packed", records.pack())
    back = rows.select("row_id", "packed", *records.unpack("packed"))
    tagged = back.withColumn("tagged", records.with_mode("Carrier"))
    return tagged.select("row_id", F.octet_length("packed").alias("bytes"), F.hex(F.conv(F.hex(F.substring("tagged", 2, 1)), 16, 10).cast("long")).alias("meta_byte"), records.mode("tagged").alias("mode"))
