"""JSON Lines with bad lines counted, comment lines, and fixtures with required keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, comment: str | None = None) -> DataFrame:
    """One row per line with the fields of ``schema`` and ``bad``; unreadable lines keep their text and are counted, not lost.

    Blank lines and lines that begin with ``comment`` are no records.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.startswith(F.ltrim("value"), F.lit(comment)))
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_bad = StructType(wanted.fields).add("_bad", "string")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.select(*[F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) for f in wanted.fields], bad.alias("bad"), "line")


def read_cases(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """JSON documents, one or an array per file; raises if a required key is missing from any of them."""
    cases = spark.read.option("multiLine", True).json(path)
    missing = [c for c in required if c not in cases.columns]
    if missing:
        raise ValueError(f"cases without {', '.join(missing)}")
    return cases


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)
