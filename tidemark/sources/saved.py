"""Saved queries: a folder of ``.sql`` files, each with a comment on top; one that fails does not stop the others."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def saved_queries(folder: str) -> list[dict]:
    """Name, description (the comment lines on top) and text of every file, by name."""
    out = []
    for p in sorted(Path(folder).glob("*.sql")):
        lines = p.read_text().splitlines()
        top = next((i for i, x in enumerate(lines) if not x.startswith("--")), len(lines))
        out.append({"name": p.stem, "about": " ".join(x.lstrip("- ").strip() for x in lines[:top]).strip(), "sql": "\n".join(lines[top:]).strip().rstrip(";")})
    return out


def run_saved_queries(spark: SparkSession, folder: str, **tables: DataFrame) -> list[dict]:
    """Each query with its result, or with the error it raised; ``tables`` are there under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    out = []
    for q in saved_queries(folder):
        try:
            out.append(q | {"result": spark.sql(q["sql"]), "error": None})
        except Exception as e:  # noqa: BLE001  # whatever it is, the next query runs
            out.append(q | {"result": None, "error": str(e).split("\n")[0]})
    return out
