"""Problem 9: disguised characters undone, genuine ones left alone."""

import pytest

import __spark_entry__
from tidemark.llm.lookalikes import consistent

DISGUISED = [
    ("ｆｕｌｌ width", "full width"), ("ﬁnd", "find"), ("\U0001d5f2nd", "end"), ("café", "café"), ("a​b", "ab"), ("a­b", "ab"), ("a﻿b", "ab"), ("a b", "a b"), ("a　b", "a b"),
    ("they wаnt it", "they want it"), ("he аѕkеԁ me", "he asked me"), ("this is nоt а case", "this is not a case"), ("этo не так", "это не так"),
]
GENUINE = [None, "", "plain\ntext", "72 m² at 20 °C, ½ price", "\U0001f469‍\U0001f467 ❤️ \U0001f937‍♀️", "he said сдаётся жильё to me", "angle α here", "Это HOST и CALLER", "café über", "می‌خواهم"]


@pytest.mark.parametrize("text,want", DISGUISED)
def test_disguised(text, want):
    assert consistent(text) == want


@pytest.mark.parametrize("text", GENUINE)
def test_genuine(text):
    assert consistent(text) == text


def test_queries(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame(list(enumerate([t for t, _ in DISGUISED] + GENUINE)), "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    q = __spark_entry__.queries()
    assert sorted(r.doc_id for r in q["p9_found"](spark, d).collect()) == list(range(len(DISGUISED)))
    assert q["p9_clean"](spark, d).count() == len(DISGUISED) + len(GENUINE)
