"""Part joins against their SQL on odd rows, and the work they do where names and prices repeat."""

import random

import duckdb

import __spark_entry__

SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def odd_parts(n=400):
    rng, pick = random.Random(5), random.Random(6).choice
    keys = [None if i % 50 == 7 else i if rng.random() < 0.7 else rng.randrange(40) for i in range(n)]
    prices = [0.0, 0.5, 0.9, 1.0, 50.0, 51.0, 51.02, 49.0, 48.99, 100.0, 98.0, 102.0, 102.4, -5.0, None]
    return [(k, pick(["red bolt", "blue bolt", "old ring", "a b c", None]), pick(["B1", "B2", "B2", "B2", None]), pick(["T1", "T1", "T2", None]), pick([1, 2, 3, None]), pick([*prices, round(rng.uniform(40, 60), 2)])) for k in keys]


def agrees(spark, d, name, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{d}/part.parquet/*.parquet'")
    got = sorted(map(tuple, __spark_entry__.queries()[name](spark, d).collect()), key=str)
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)
    assert got == want and want


def test_d12_on_odd_parts(spark, tmp_path):
    agrees(spark, str(tmp_path), "d12_band_join", odd_parts())


def test_d13_on_odd_parts(spark, tmp_path):
    agrees(spark, str(tmp_path), "d13_price_band", odd_parts())


def test_d13_takes_the_first_of_many(spark, tmp_path):
    rng = random.Random(2)
    agrees(spark, str(tmp_path), "d13_price_band", [(k, "x", rng.choice(["B1", "B1", "B1", "B2"]), "T", 1, round(rng.uniform(95, 105), 1)) for k in range(1200)])


def test_h16_on_odd_parts(spark, tmp_path):
    agrees(spark, str(tmp_path), "h16_best_duplicates", odd_parts())


def test_h16_asks_few_of_many_alike(spark, tmp_path):
    from tidemark.plans.checks import _best_of_bands

    rng = random.Random(8)
    rows = [(k, "red bolt", rng.choice(["B1", "B2"]), rng.choice(["T1", "T2"]), rng.choice([1, 2, None]), rng.choice([50.0, 50.5, 80.0, None])) for k in range(500)]
    agrees(spark, str(tmp_path), "h16_best_duplicates", rows)
    assert _best_of_bands(spark.read.parquet(f"{tmp_path}/part.parquet")).distinct().count() <= 6 * len(rows)  # and not all pairs
