"""Streams over growing folders."""

from pyspark.sql import functions as F

from tidemark.streaming import operators as S
from tidemark.streaming.runs import drained, file_stream

SCHEMA = "record_id string, at bigint, text string, removed boolean"


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_upsert_over_several_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    steps = [[("e1", 1, "t", False), ("e2", 1, "a", False), ("e3", 1, "x", False), (None, 1, "n", False)], [("e1", 2, "t", False), ("e2", 2, "b", False), ("e3", 2, None, True)], [("e3", 3, "x", False), ("e2", 3, "b", False)]]
    for rows in steps:
        add(spark, src, rows)
        stream = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        result = drained(S.keyed_upsert(stream), "t", "update", folder=out)
    last = {}
    for r in result.collect():
        if r.record_id not in last or r.sightings >= last[r.record_id].sightings:
            last[r.record_id] = r
    assert {k: (r.first_seen, r.last_seen, r.sightings, r.revisions, r.removed) for k, r in last.items()} == {"e1": (1, 2, 2, 0, False), "e2": (1, 3, 3, 1, False), "e3": (1, 3, 2, 0, False)}


def test_dedup_remembers_earlier_runs(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, "t", False), ("a", 2, "t", False), (None, 1, "t", False)], [("a", 3, "t", False), ("b", 1, "t", False)]):
        add(spark, src, rows)
        stream = file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema)
        got = drained(S.first_sightings(stream, "record_id").select("record_id"), "t", folder=out)
    assert sorted(r.record_id for r in got.collect()) == ["a", "b"]


def test_latest_per_key(spark, tmp_path):
    src = str(tmp_path / "in")
    add(spark, src, [("a", 1, "t", False), ("a", 5, "t", False), ("b", 2, "t", False)])
    got = drained(S.latest_per_key(file_stream(spark, src, spark.createDataFrame([], SCHEMA).schema), "record_id", "at"), "t", "complete")
    assert {(r.record_id, r["at"], r.rows) for r in got.withColumn("x", F.lit(1)).collect()} == {("a", 5, 2), ("b", 2, 1)}
