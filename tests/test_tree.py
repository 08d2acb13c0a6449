"""Tree aggregation with hot keys, more than fan-in chunks per task, and nulls."""

from pyspark.sql import functions as F

from tidemark.operators.tree import frequent_keys, task_states, tree_aggregate


def data(spark, parts):
    rows = [("hot" if i % 3 else f"k{i % 50}", None if i % 7 == 0 else "x", i) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, p string, n int").withColumn("task", F.lit(1)).withColumn("field_name", F.lit("z")).repartition(parts)


def test_equals_group_by_whatever_the_partitioning(spark):
    for parts, chunk, fan in ((1, 10, 2), (9, 7, 3), (40, 1000, 2)):
        df = data(spark, parts)
        got = {(r.field_name, r.key_value): (r.rows, r.total) for r in tree_aggregate(df, {"k": F.col("k"), "p": F.col("p")}, {"rows": F.lit(1), "total": F.col("n")}, chunk_rows=chunk, fan_in=fan).collect()}
        want = {(f, r[f]): (r["c"], r["s"]) for f in ("k", "p") for r in df.groupBy(f).agg(F.count("*").alias("c"), F.sum("n").alias("s")).collect()}
        assert got == want


def test_a_task_sends_one_state_per_key(spark):
    states = task_states(data(spark, 5), {"k": F.col("k")}, {"n": F.lit(1)}, chunk_rows=16, fan_in=2)
    assert states.groupBy("key_value", "task").count().agg(F.max("count")).first()[0] == 1
    assert states.agg(F.sum("s0")).first()[0] == 3000


def test_empty_and_null_sums(spark):
    none = spark.createDataFrame([], "k string, n int")
    assert tree_aggregate(none, {"k": F.col("k")}, {"n": F.col("n")}).count() == 0
    assert frequent_keys(none, ["k"], 0.05).count() == 0
    one = spark.createDataFrame([("a", None), (None, 2), ("", 3)], "k string, n int")
    assert {(r.key_value, r.n) for r in tree_aggregate(one, {"k": F.col("k")}, {"n": F.col("n")}).collect()} == {("a", 0), (None, 2), ("", 3)}
    assert {r.key_value for r in frequent_keys(one, ["k"], 0.3).collect()} == {"a", ""}
