"""Vector search, clusters and threshold sweeps over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import vectors as V
from tidemark.session import shuffle_width, table, written

K, THRESHOLD = 10, 0.3
#: Parts of one name hash that meet those of another in one task.
SLICE = 1000


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _neighbours(spark: SparkSession, d: str, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    v = _vectors(spark, d)
    return V.top_k_neighbours(v, v, k, threshold, record_id="vec_id", vector="embedding")


def d18_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("id", "other", F.round("similarity", 6).alias("similarity"), "rank")


def d20_mutual(spark: SparkSession, d: str) -> DataFrame:
    return V.mutual(_neighbours(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def g04_nearest_with_label(spark: SparkSession, d: str) -> DataFrame:
    """Of each vector's five nearest, the first of its own label."""
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), "label")
    near = _neighbours(spark, d, 5, -1.0).join(v, "id").join(v.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other").where("label = other_label")
    return near.groupBy("id").agg(F.min_by("other", "rank").alias("match"))


def k01_components(spark: SparkSession, d: str) -> DataFrame:
    return V.connected_components(V.mutual(_neighbours(spark, d)))


def k02_clusters(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """Components of the mutual-neighbour graph with at least ``least`` members."""
    c = k01_components(spark, d)
    return c.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("members")).where(F.col("size") >= least)


def k04_cluster_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of each component with their similarity to its centroid and the component's coherence."""
    c = written(k01_components(spark, d), "members").join(_vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding"), "id")
    m = c.join(V.centroids(c, "component", "embedding"), "component").select("component", "id", V.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    mean = m.groupBy("component").agg(F.round(F.avg("s"), 4).alias("coherence"), F.count("*").alias("size"))
    return m.join(mean, "component").where("size >= 3").select("component", "id", F.round("s", 4).alias("similarity"), "coherence")


def e46_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of each label's vectors to their centroid, and the centroid's norm."""
    v = _vectors(spark, d)
    c = v.join(F.broadcast(V.centroids(v, "label", "embedding")), "label")  # one row per label
    return c.groupBy("label").agg(F.count("*").alias("vectors"), F.round(F.avg(V.cosine(F.col("embedding"), F.col("centroid"))), 6).alias("coherence"))


def e39_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Confusion counts of "same label" by similarity threshold over the neighbour pairs, with the best F1 marked."""
    v = _vectors(spark, d).select(F.col("vec_id").alias("id"), "label")
    pairs = _neighbours(spark, d, 5, 0.2).where("id < other").join(v, "id").join(v.select(F.col("id").alias("other"), F.col("label").alias("l2")), "other").select((F.col("label") == F.col("l2")).alias("same"), F.round("similarity", 6).alias("s"))
    cut = pairs.select("same", "s", F.explode(F.transform(F.sequence(F.lit(20), F.lit(50), F.lit(5)), lambda t: t / F.lit(100.0))).alias("threshold"))
    hit = F.col("s") >= F.col("threshold")
    c = cut.groupBy("threshold").agg(F.count_if(hit & F.col("same")).alias("tp"), F.count_if(hit & ~F.col("same")).alias("fp"), F.count_if(~hit & F.col("same")).alias("fn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return c.select("threshold", "tp", "fp", "fn", F.round(f1, 6).alias("f1"))


def h06_semantic_dedup(spark: SparkSession, d: str, threshold: float = 0.35) -> DataFrame:
    """Vectors kept in id order when each is dropped that is near an earlier kept one."""
    v = _vectors(spark, d)
    near = V.top_k_neighbours(v, v, v.count(), threshold, record_id="vec_id", vector="embedding").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return V.greedy_dedup(near, v.select(F.col("vec_id").alias("id")))


def j14_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the one of the next id."""
    v = _vectors(spark, d).select("vec_id", "embedding")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


def j15_hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    e = V.hash_embedding(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.round(e[0], 6).alias("first"), F.round(e[31], 6).alias("last"), F.round(F.aggregate(e, F.lit(0.0).cast("double"), lambda s, x: s + x), 5).alias("total"))


def d12_band_join(spark: SparkSession, d: str, most: int = 12) -> DataFrame:
    """Parts of different brands whose name hashes share a byte at its place and differ in at most ``most`` bits."""
    parts = hashed_parts(table(spark, d, "part"))
    return band_pairs(parts, parts, most).select("p_partkey", "k2", "bits")


def hashed_parts(p: DataFrame) -> DataFrame:
    """One row per key and name hash, with its least and greatest brand."""
    h = F.substring(F.sha2("p_name", 256), 1, 16)
    return p.select("p_partkey", "p_brand", h.alias("h")).where("p_partkey is not null and p_brand is not null and h is not null").groupBy("p_partkey", "h").agg(F.min("p_brand").alias("b_lo"), F.max("p_brand").alias("b_hi"))


def near_hashes(hashes: DataFrame, most: int) -> DataFrame:
    """``(h, h2, bits)`` of the distinct hashes that share a byte at its place, both ways and each with itself."""
    banded = hashes.select("h").distinct().withColumn("band", F.explode(V.bands(F.col("h"))))
    other = banded.select(F.col("h").alias("h2"), "band")
    near = banded.join(other, "band").withColumn("bits", V.hamming64(F.col("h"), F.col("h2"))).where(F.col("bits") <= most)
    return near.select("h", "h2", "bits").distinct()


def band_pairs(parts: DataFrame, others: DataFrame, most: int = 12) -> DataFrame:
    """``(p_partkey, k2, h, h2, bits)`` of two sets of ``hashed_parts`` of different brands with near hashes, p_partkey < k2, each once.

    Hashes are compared once however many parts have them; parts then meet by equal hash. The parts of a frequent hash
    are cut into slices, each of which meets all parts of the near hash in a task of its own, so the output is spread.
    """
    spark = parts.sparkSession
    most_frequent = others.groupBy("h").count().agg(F.max("count")).first()[0] or 0
    slices = max(1, -(-most_frequent // SLICE))
    width = shuffle_width(spark) * slices
    left = parts.join(near_hashes(parts.select("h").unionByName(others.select("h")), most), "h").withColumn("slice", F.pmod(F.xxhash64("p_partkey"), F.lit(slices))).repartition(width, "h2", "slice")
    right = others.select(F.col("p_partkey").alias("k2"), F.col("h").alias("h2"), F.col("b_lo").alias("b2_lo"), F.col("b_hi").alias("b2_hi"))
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint")))).repartition(width, "h2", "slice")
    pairs = left.join(right.hint("shuffle_hash"), ["h2", "slice"]).where("p_partkey < k2 and (b_lo <> b2_hi or b_hi <> b2_lo)")
    return pairs.select("p_partkey", "k2", "h", "h2", "bits")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_DOT = "list_cosine_similarity(x.e, y.e)"
_V = "v as (select vec_id, label, embedding::double[] e from embeddings)"
_N = lambda k, t: f"{_V}, s as (select x.vec_id id, y.vec_id other, round({_DOT}, 12) s from v x join v y on x.vec_id <> y.vec_id), n as (select id, other, s, cast(row_number() over (partition by id order by s desc, other desc) as integer) rank from s where s >= {t} qualify rank <= {k})"
_MUTUAL = "m as (select n.id a, n.other b, n.s from n join n r on r.id = n.other and r.other = n.id where n.id < n.other)"

ORACLE = {
    "d18_neighbours": f"with {_N(10, 0.3)} select id, other, round(s, 6) similarity, rank from n",
    "d20_mutual": f"with {_N(10, 0.3)}, {_MUTUAL} select a, b, round(s, 6) similarity from m",
    "g04_nearest_with_label": f"with {_N(5, -1)} select n.id, arg_min(n.other, rank) as match from n join v x on x.vec_id = n.id join v y on y.vec_id = n.other where x.label = y.label group by n.id",
    "e46_centroids": f"with {_V}, u as (select label, unnest(range(64)) i, unnest(embedding)::double z from embeddings), c as (select label, list(m order by i) c from (select label, i, avg(z) m from u group by all) group by label) select label, count(*) vectors, round(avg(list_cosine_similarity(e, c)), 6) coherence from v join c using (label) group by label",
    "e39_threshold_sweep": f"with {_N(5, 0.2)}, p as (select x.label = y.label same, round(n.s, 6) s from n join v x on x.vec_id = n.id join v y on y.vec_id = n.other where n.id < n.other), t as (select unnest(range(20, 51, 5)) / 100 threshold), c as (select threshold, count(*) filter (s >= threshold and same) tp, count(*) filter (s >= threshold and not same) fp, count(*) filter (s < threshold and same) fn from p, t group by threshold) select threshold, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) f1 from c",
    "j14_cosine": f"with {_V} select x.vec_id, round({_DOT}, 6) cosine from v x join v y on y.vec_id = x.vec_id + 1",
    "d12_band_join": "with p as (select p_partkey, p_brand, substr(sha256(p_name), 1, 16) h from part), b as (select *, unnest(range(8)) i from p), c as (select distinct x.p_partkey, y.p_partkey k2, x.h, y.h h2 from b x join b y on x.i = y.i and substr(x.h, x.i * 2 + 1, 2) = substr(y.h, y.i * 2 + 1, 2) and x.p_partkey < y.p_partkey and x.p_brand <> y.p_brand) select p_partkey, k2, cast(bit_count(xor(cast('0x' || h as ubigint), cast('0x' || h2 as ubigint))) as integer) bits from c where bit_count(xor(cast('0x' || h as ubigint), cast('0x' || h2 as ubigint))) <= 12",
}
_CC = f"{_N(10, 0.3)}, {_MUTUAL}, g as (select a, b from m union select b, a from m), r(id, c) as (select a, a from g union select g.b, r.c from r join g on g.a = r.id), k as (select id, min(c) component from r group by id)"
ORACLE["k01_components"] = "with recursive " + _CC + " select id, component from k"
ORACLE["k02_clusters"] = "with recursive " + _CC + " select component, count(*) size, string_agg(id::varchar, ',' order by id) members from k group by component having count(*) >= 3"
