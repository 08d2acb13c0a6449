"""Named sources: a function from (spark, place, query, since, limit) to records, looked up by name; and a replay source.

``replay`` is a Spark data source over captured JSON Lines, so a saved answer of a site is read like any other format.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

Search = Callable[[SparkSession, str, str, str, int], DataFrame]
_SOURCES: dict[str, Search] = {}


def register(name: str, search: Search) -> None:
    if name in _SOURCES:
        raise ValueError(f"source {name} is registered already")
    _SOURCES[name] = search


def get_source(name: str) -> Search:
    if name not in _SOURCES:
        raise KeyError(f"no source {name}; there are {', '.join(available()) or 'none'}")
    return _SOURCES[name]


def available() -> list[str]:
    return sorted(_SOURCES)


class _Lines(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _ReplayReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str]) -> None:
        self.schema, self.paths = schema, paths

    def partitions(self) -> list[InputPartition]:
        return [_Lines(p) for p in self.paths]

    def read(self, partition: _Lines) -> Iterator[tuple]:
        import pyarrow.fs as fs

        where, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        names = [f.name for f in self.schema.fields]
        with where.open_input_stream(path) as f:
            for line in f.read().decode().splitlines():
                try:
                    r = json.loads(line)
                except ValueError:
                    continue
                if isinstance(r, dict):
                    yield tuple(None if r.get(n) is None else str(r[n]) for n in names)


class Replay(DataSource):
    """``spark.read.format("replay").option("paths", "a,b")``: captured records, all fields as text; bad lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "id string, title string, text string, created string, url string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ReplayReader(schema, [p for p in self.options.get("paths", "").split(",") if p])


def replay_search(spark: SparkSession, place: str, query: str, since: str, limit: int) -> DataFrame:
    """Captured records that hold every word of the query, not older than ``since`` where dated, newest first."""
    spark.dataSource.register(Replay)
    r = spark.read.format("replay").option("paths", place).load()
    text = F.lower(F.concat_ws(" ", "title", "text"))
    for w in query.lower().split():
        r = r.where(F.contains(text, F.lit(w)))
    if since:
        r = r.where(F.col("created").isNull() | (F.col("created") >= since))
    return r.orderBy(F.desc_nulls_last("created"), "id").limit(limit)


register("replay", replay_search)
