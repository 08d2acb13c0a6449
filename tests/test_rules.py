"""Rule families: word borders, weights, vetoes and reasons."""

from pyspark.sql import functions as F

from tidemark.operators import rules as R

RULES = R.Rules((R.Family("pain", "buyer", 0.4, ("gave up", "c++")), R.Family("ask", "buyer", 0.3, ("anyone",)), R.Family("setup", "practitioner", 0.6, ("my rig",)), R.Family("ad", "reject", 1.0, ("hiring",))))


def verdict(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(R.classify(F.col("t"), RULES).alias("c")).first().c
    return r.audience, r.score, r.ambiguous, r.reason


def test_classify(spark):
    assert verdict(spark, "I GAVE UP. Anyone?") == ("buyer", 0.7, False, "[matched: gave up, anyone]")
    assert verdict(spark, "gave up, gave up") == ("none", 0.4, False, "[matched: gave up]")
    assert verdict(spark, "anyone gave up on my rig") == ("buyer", 0.7, True, "[matched: gave up, anyone, my rig]")
    assert verdict(spark, "on my rig") == ("practitioner", 0.6, False, "[matched: my rig]")
    assert verdict(spark, "gave up, anyone, hiring")[0] == "none"
    assert verdict(spark, "anyones https://x.example/gave up érgave up")[3] == ""
    assert verdict(spark, "c++ is hard")[3] == "[matched: c++]"
    assert verdict(spark, None) == verdict(spark, "") == ("none", 0.0, False, "")


def test_reasons_read_back(spark):
    df = spark.createDataFrame([("[matched: a b, c]",), ("nothing",), (None,)], "r string")
    assert [r.p for r in df.select(R.matched_phrases(F.col("r")).alias("p")).collect()] == [["a b", "c"], [], None]


def test_filters_and_first_rule(spark):
    df = spark.createDataFrame([("Export it",), ("export to cloud",), ("other",), (None,)], "t string")
    got = df.select(R.keep_by_words(F.col("t"), ("export",), ("cloud",)).alias("k"), R.keep_by_words(F.col("t")).alias("all"), R.first_rule(F.col("t"), [("e", "export"), ("c", "cloud")], "none").alias("f")).collect()
    assert [tuple(r) for r in got] == [(True, True, "e"), (False, True, "e"), (False, True, "none"), (False, True, "none")]
