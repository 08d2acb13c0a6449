"""Vector operators: cosine, exact k nearest neighbours in blocks, mutual neighbours, components, centroids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: Vectors of one block; a task holds one block of queries and one of the base at a time.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """A zero vector has norm 1, so its cosine is 0."""
    norm = lambda v: F.sqrt(dot(v, v))
    unit = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (unit(norm(a)) * unit(norm(b)))


def _matrix(a: pa.ChunkedArray) -> np.ndarray:
    a = a.combine_chunks()
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(a), -1) if len(a) else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def top_k_neighbours(queries: DataFrame, base: DataFrame, k: int, threshold: float, *, record_id: str, vector: str, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """``(id, other, similarity)``: the ``k`` most similar others of every query at or above ``threshold``, exactly.

    Both sides are cut into blocks by the hash of the id and every two blocks meet once, as one matrix product; a task
    keeps ``k`` candidates per query and block, and the best of those are the answer. Of equal similarities the greater
    id comes first. Null vectors and ids take no part; vectors must be of one length.
    """
    q = queries.select(F.col(record_id).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    b = base.select(F.col(record_id).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    if blocks is None:
        blocks = max(1, -(-base.count() // block))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = q.select("id", "v", own.alias("qb"), every.alias("bb"))
    right = b.select("id", "v", own.alias("bb"), every.alias("qb"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        out = {"id": [], "other": [], "similarity": []}
        if len(x) and len(y):
            ids, others = x["id"].to_numpy(), y["id"].to_numpy()
            order = np.argsort(-others, kind="stable")
            others, m = others[order], _matrix(y["v"])[order]
            for at in range(0, len(x), 512):
                s = np.round(_matrix(x["v"].slice(at, 512)) @ m.T, 12)
                s[ids[at : at + 512, None] == others[None, :]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                for i, row in enumerate(best):
                    for j in row:
                        if s[i, j] >= threshold:
                            out["id"].append(ids[at + i]), out["other"].append(others[j]), out["similarity"].append(s[i, j])
        return pa.table({"id": pa.array(out["id"], pa.int64()), "other": pa.array(out["other"], pa.int64()), "similarity": pa.array(out["similarity"], pa.float64())})

    near = left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInArrow(meet, "id bigint, other bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("other")))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """``(a, b, similarity)``, a < b, of the pairs that are each other's neighbours."""
    n = neighbours.select("id", "other", "similarity")
    back = n.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return n.where("id < other").join(back, ["id", "other"], "left_semi").select(F.col("id").alias("a"), F.col("other").alias("b"), "similarity")


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` of every end of an edge; the component is its smallest id.

    Alternating large-star and small-star rounds: each links neighbours to the smallest id they know, so the number of
    rounds is logarithmic in the size of a component. Every round is written to the shared folder, so plans stay flat
    and a lost executor costs one round. Self loops give a component of one; repeated edges count once.
    """
    both = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u is not null and v is not null")
    ends = both.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    now, total = written(both.where("u <> v").distinct(), "components"), None
    while True:
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        around = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        now = written(small, "components")
        state = now.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == total:
            break
        total = state
    return ends.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The mean vector of each key, position by position; combined before the shuffle."""
    each = df.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def hash_embedding(c: Column, dims: int = 32) -> Column:
    """A unit vector from the text's SHA-256, byte by byte: the same text always gets the same vector."""
    h = F.sha2(c, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int") - 128) / F.lit(128.0))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0).cast("double"), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def hamming64(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hexadecimal hashes; 64 where one cannot be read."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    ok = F.coalesce(a.rlike("^[0-9a-fA-F]{16}$"), F.lit(False)) & F.coalesce(b.rlike("^[0-9a-fA-F]{16}$"), F.lit(False))
    bits = lambda at: F.bit_count(half(a, at).bitwiseXOR(half(b, at)))
    return F.when(ok, bits(1) + bits(9)).otherwise(64)


def bands(c: Column, n: int = 8) -> Column:
    """A hash as its bytes with their position: two hashes within ``n`` - 1 bits share one."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substr(c, i * 2 + 1, F.lit(2))))


def first_after(at: np.ndarray, lo: np.ndarray, hi: np.ndarray, brand: np.ndarray, value: np.ndarray, brands: np.ndarray) -> np.ndarray:
    """Per query the first position from ``at`` whose ``value`` is in [``lo``, ``hi``) and whose brand is another; -1 if none.

    A tree over the positions is climbed and then descended for all queries at once; a block's rows in a range are
    counted in its sorted values, those of one brand in the values sorted by brand.
    """
    n, out = len(value), np.full(len(at), -1, np.int64)
    if not n or not len(at):
        return out
    distinct, value = np.unique(value, return_inverse=True)
    lo, hi = np.searchsorted(distinct, lo), np.searchsorted(distinct, hi)
    size, kinds, position = len(distinct) + 1, int(max(brands.max(), brand.max())) + 1, np.arange(n)
    levels = [(np.sort((position >> k) * size + value), np.sort(((position >> k) * kinds + brands) * size + value)) for k in range(max(1, n.bit_length() + 1))]

    def some(k: int, block: np.ndarray, i: np.ndarray) -> np.ndarray:
        every, own = levels[k]
        in_range = np.searchsorted(every, block * size + hi[i]) - np.searchsorted(every, block * size + lo[i])
        b = (block * kinds + brand[i]) * size
        return in_range > np.searchsorted(own, b + hi[i]) - np.searchsorted(own, b + lo[i])

    i = np.flatnonzero((lo < hi) & (at < n))
    block, level = at.astype(np.int64).copy(), np.full(len(at), -1)
    for k in range(len(levels)):
        odd = i[(block[i] & 1 == 1) | (k == len(levels) - 1)]
        found = some(k, block[odd], odd)
        level[odd[found]] = k
        block[odd[~found]] += 1
        i = i[level[i] < 0]
        i = i[block[i] << k < n]
        block[i] >>= 1
    for k in range(len(levels) - 1, 0, -1):
        down = np.flatnonzero(level >= k)
        block[down] <<= 1
        block[down[~some(k - 1, block[down], down)]] += 1
    out[level >= 0] = block[level >= 0]
    return out


def greedy_dedup(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, kept)`` in id order: a row is a duplicate if an earlier kept row is near; ``pairs`` is (a, b), a < b.

    Rows whose earlier neighbours are all decided are decided together, round by round; each round is written.
    """
    edges, dropped, n = written(pairs.select("a", "b").distinct(), "greedy-edges"), None, 0
    while not edges.isEmpty():
        kept_now = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_anti")
        gone = written(edges.join(kept_now, "a").select(F.col("b").alias("id")).distinct(), f"greedy-{n}")
        dropped, n = gone if dropped is None else dropped.unionByName(gone), n + 1
        edges = written(edges.join(kept_now, "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti"), f"greedy-edges-{n}")
    if dropped is None:
        return ids.select("id", F.lit(True).alias("kept"))
    return ids.join(dropped.distinct().withColumn("gone", F.lit(True)), "id", "left").select("id", F.col("gone").isNull().alias("kept"))
