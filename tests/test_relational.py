"""Shared relational operators against plain Python."""

import random

from pyspark.sql import functions as F

from tidemark.operators import relational as R
from tidemark.operators.sampling import proportional_sizes


def test_latest_by_fixes_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "n"), ("b", None, "q")]
    got = {(r.k, r.t, r.v) for r in R.latest_by(spark.createDataFrame(rows, "k string, t int, v string"), ["k"], [F.col("t")]).collect()}
    assert got == {("a", 2, "z"), (None, 5, "n"), ("b", None, "q")}


def test_first_wins_keeps_blank_keys(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b")], "id int, k string")
    assert {r.id: r.kept_id for r in R.first_wins(df, F.col("k"), [F.col("id")], "id").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_running_budget_over_many_slices(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 5, None])) for i in range(500)]
    total, want = 0, []
    for i, n in rows:
        if total < 300:
            want.append(i)
        total += n or 0
    df = spark.createDataFrame(rows, "id int, n int").repartition(7)
    assert sorted(r.id for r in R.running_budget(df, F.col("n"), ["id"], 300, slices=5).collect()) == want
    assert R.running_budget(df.limit(0), F.col("n"), ["id"], 300).count() == 0


def test_keyed_merge(spark):
    old = spark.createDataFrame([("1", "a", None), ("2", "b", ""), ("3", "c", "x")], "id string, t string, u string")
    new = spark.createDataFrame([("1", "a", ""), ("2", "B", None), ("4", "d", "x")], "id string, t string, u string")
    assert {r.id: r.change for r in R.keyed_merge(old, new, "id", ["t", "u"]).collect()} == {"1": "seen_again", "2": "edited", "3": "absent", "4": "new"}


def test_streaks(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("c", 1, True), ("d", 1, None)]
    got = {r.k: r.streak for r in R.streaks(spark.createDataFrame(rows, "k string, n int, bad boolean"), ["k"], [F.desc("n")], F.col("bad")).collect()}
    assert got == {"a": 2, "b": 0, "c": 1, "d": 0}


def test_zero_filled_days(spark):
    df = spark.sql("select date'2026-01-01' as day, 2 as n union all select date'2026-01-04', 1")
    assert [r.n for r in R.zero_filled_days(df, "day", ["n"]).orderBy("day").collect()] == [2, 0, 0, 1]
    assert R.zero_filled_days(df.limit(0), "day", ["n"]).count() == 0


def test_proportional_sizes():
    assert proportional_sizes({"a": 60, "b": 30, "c": 10}, 10) == {"a": 6, "b": 3, "c": 1}
    assert proportional_sizes({"a": 1, "b": 1, "c": 500}, 2) == {"a": 1, "c": 1}
    assert proportional_sizes({"a": 5, "b": 0}, 99) == {"a": 5}
    assert proportional_sizes({}, 5) == {} and proportional_sizes({"a": 5}, 0) == {}
    for total in range(1, 40):
        pools = {"a": 3, "b": 17, "c": 1, "d": 9}
        got = proportional_sizes(pools, total)
        assert sum(got.values()) == min(total, 30) and all(n <= pools[k] for k, n in got.items())
