"""Readers, exports, the registry and saved queries."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import export, jsonl, registry, saved


def test_jsonl_counts_bad_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('# note\n{"a": 1, "b": "x"}\n\nnot json\n{"a": "no number"}\n{"b": "y", "c": 3}\n')
    rows = jsonl.read_jsonl(spark, str(p), "a int, b string", comment="#").collect()
    assert {(r.a, r.b) for r in rows if not r.bad} == {(1, "x"), (None, "y")}
    assert sum(r.bad for r in rows) == 2 and len(rows) == 4


def test_cases_need_their_keys(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"id": 1, "why": "x"}]))
    assert jsonl.read_cases(spark, str(tmp_path), ["id", "why"]).count() == 1
    with pytest.raises(ValueError, match="expect"):
        jsonl.read_cases(spark, str(tmp_path), ["id", "expect"])


def test_export_reads_back_whole(spark, tmp_path):
    rows = [(1, 'say "hi", ok', "a"), (2, "two\nlines", None), (3, "", "a"), (4, None, "b/c"), (5, " spaced ", "a"), (None, "x", "a")]
    df = spark.createDataFrame(rows, "id bigint, text string, kind string")
    path = str(tmp_path / "out")
    for _ in range(2):  # a second export replaces the first
        m = export.export_csv(df, path, "id", by=["kind"], rows_per_file=1)
    assert m["rows"] == 6 and m["ids"] == 6 and json.loads((tmp_path / "out" / "_manifest.json").read_text()) == m
    assert sorted(map(tuple, export.read_csv(spark, path, df).collect()), key=repr) == sorted(rows, key=repr)
    assert len(list((tmp_path / "out").rglob("*.csv"))) == 6


def test_identity_does_not_depend_on_order(spark):
    a = spark.range(50).withColumn("id", F.col("id").cast("string"))
    same = export.identity(a.orderBy(F.desc("id")).repartition(3), "id").first()
    assert export.identity(a, "id").first() == same
    assert export.identity(a.where("id <> '7'"), "id").first().digest != same.digest


def test_registry_and_replay(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id": 1, "title": "Big crash", "created": "2026-02-01"}\nbroken\n{"id": 2, "text": "a crash", "created": "2025-01-01"}\n{"id": 3, "text": "crash, undated"}\n{"id": 4, "text": "fine"}\n')
    assert "replay" in registry.available()
    with pytest.raises(ValueError):
        registry.register("replay", registry.replay_search)
    with pytest.raises(KeyError, match="replay"):
        registry.get_source("nowhere")
    got = registry.get_source("replay")(spark, str(p), "CRASH", "2026-01-01", 9).collect()
    assert [r.id for r in got] == ["1", "3"]


def test_saved_queries_fail_alone(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- counts\n-- all rows\nselect count(*) n from t;\n")
    (tmp_path / "b.sql").write_text("select nothing from nowhere")
    out = saved.run_saved_queries(spark, str(tmp_path), t=spark.range(3))
    assert [(q["name"], q["about"]) for q in out] == [("a", "counts all rows"), ("b", "")]
    assert out[0]["result"].first().n == 3 and out[1]["result"] is None and out[1]["error"]
