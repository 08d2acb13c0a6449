"""Neighbours, components and greedy dedup against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import vectors as V


def test_neighbours_equal_brute_force_over_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5)).round(2)
    x[7], x[9], x[11] = x[3], x[3], 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "id bigint, v array<double>").withColumn("bb", F.lit(0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round((x / np.where(norm == 0, 1, norm)) @ (x / np.where(norm == 0, 1, norm)).T, 12)
    want = {i: [j for _, j in sorted(((s[i, j], j) for j in range(60) if j != i and s[i, j] >= 0.2), reverse=True)[:4]] for i in range(60)}
    for blocks in (1, 4):
        got = {}
        for r in V.top_k_neighbours(df, df, 4, 0.2, record_id="id", vector="v", blocks=blocks).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append(r.other)
        assert got == {i: w for i, w in want.items() if w}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randint(0, 50), rng.randint(0, 50)) for _ in range(30)] + [(200, 200), (140, 100), (5, 5)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in V.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: find(a) for a in root}
    assert V.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_greedy_dedup_is_sequential(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (6, 9), (7, 9)]
    ids = spark.createDataFrame([(i,) for i in range(1, 11)], "id bigint")
    got = {r.id for r in V.greedy_dedup(spark.createDataFrame(pairs, "a bigint, b bigint"), ids).collect() if r.kept}
    assert got == {1, 3, 5, 6, 7, 8, 10}
    assert V.greedy_dedup(spark.createDataFrame([], "a bigint, b bigint"), ids).where("kept").count() == 10


def test_hamming_and_bands(spark):
    r = spark.createDataFrame([("00000000000000ff", "0000000000000000", "bad", None)], "a string, b string, c string, n string").select(
        V.hamming64(F.col("a"), F.col("b")), V.hamming64(F.col("a"), F.col("c")), V.hamming64(F.col("a"), F.col("n")), V.bands(F.col("a"))
    ).first()
    assert r[0] == 8 and r[1] == 64 and r[2] == 64 and r[3][0] == "0:00" and r[3][7] == "7:ff"


def test_hash_embedding_has_unit_norm(spark):
    v = spark.createDataFrame([("x",), ("",)], "t string").select(V.hash_embedding(F.col("t")).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 and len(r.v) == 32 for r in v)
