"""Differences between two copies whose columns are named like the operator's own."""

from pyspark.sql import functions as F

from tidemark.operators import compare


def test_columns_named_like_helpers(spark):
    names = ["bucket", "o", "k", "v", "v0", "record_id", "difference"]
    schema = "id string, " + ", ".join(f"{c} string" for c in names) + ", at int"
    left = spark.createDataFrame([("a", *"1234567", 1), ("b", *"1111111", 1)], schema)
    right = spark.createDataFrame([("a", *"9999999", 2), ("b", *"1111111", 1), ("a", *"0000000", 1)], schema)
    out = compare.table_differences(
        left, right, key="id", values={c: (compare.text_value,) * 2 for c in names}, left_order=F.col("at"), right_order=F.col("at"), left_name="l", right_name="r",
    )
    assert sorted(map(tuple, out.collect())) == sorted(("a", c, x, "9") for c, x in zip(names, "1234567"))


def diff(left, right, **kw):
    names = [c for c in left.columns if c not in ("id", "at")]
    out = compare.table_differences(left, right, key="id", values={c: (compare.text_value,) * 2 for c in names}, left_order=F.col("at"), right_order=F.col("at"), left_name="l", right_name="r", **kw)
    return sorted(map(tuple, out.collect()), key=repr)


def test_moved_nulls_missing_rows_null_keys_and_versions(spark):
    schema = "id string, a string, b string, at int"
    left = spark.createDataFrame([("1", None, "x", 1), ("2", "", "y", 1), (None, "k", None, 1), ("4", "\x00", "q", 1), ("5", "old", "z", 1), ("5", "new", "z", 2)], schema)
    right = spark.createDataFrame([("1", "x", None, 1), ("2", None, "y", 9), (None, "k", "", 1), ("3", "only", "here", 1), ("4", None, "q", 1), ("5", "new", "z", 1)], schema)
    want = sorted([("1", "a", None, "x"), ("1", "b", "x", None), ("3", "r", None, None), ("4", "a", "\x00", None)], key=repr)
    assert diff(left, right) == want
    assert diff(left, right, broadcast_keys=0, bucket_keys=1) == want


def test_empty_copies(spark):
    schema = "id string, a string, at int"
    one, none = spark.createDataFrame([("1", "x", 1)], schema), spark.createDataFrame([], schema)
    assert diff(one, none) == [("1", "l", None, None)] and diff(none, one) == [("1", "r", None, None)] and diff(none, none) == []


def test_instants_do_not_depend_on_the_session_zone(spark):
    texts = [("2026-02-15T10:11:12Z",), ("2026-02-15 10:11:12",), ("2026-02-15T12:11:12+02:00",), ("2026-02-15T10:11:12.000+00:00",), ("2026-02-15",), ("2026",), ("10:11",), ("soon",), ("",), (None,)]
    df, zone = spark.createDataFrame(texts, "t string"), spark.conf.get("spark.sql.session.timeZone")
    got = []
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got.append([r[0] for r in df.select(compare.instant_text(F.col("t"))).collect()])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got[0] == got[1] == ["1771150272000"] * 4 + ["1771113600000", "2026", "10:11", "soon", None, None]
