"""Tree aggregation: exact per-key results when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows that make one input chunk.
CHUNK_ROWS = 65_536
#: Partial states one merge takes per key.
FAN_IN = 16


def _merge(states: list[pa.Table], sums: Sequence[str]) -> pa.Table:
    t = pa.concat_tables(states).group_by(["field_name", "key_value"]).aggregate([(s, "sum") for s in sums])
    return t.rename_columns(["field_name", "key_value", *sums] if t.column_names[0] == "field_name" else [*sums, "field_name", "key_value"]).select(["field_name", "key_value", *sums])


class _Tree:
    """States by level; ``fan_in`` states of one level become one of the next."""

    def __init__(self, sums: Sequence[str], fan_in: int) -> None:
        self.sums, self.fan_in, self.levels = sums, fan_in, [[]]

    def add(self, state: pa.Table, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(state)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self.add(_merge(full, self.sums), level + 1)

    def root(self) -> pa.Table | None:
        rest: list[pa.Table] = []
        for states in self.levels:
            rest = [_merge(rest + states, self.sums)] if rest + states else []
        return rest[0] if rest else None


def task_states(df: DataFrame, keys: dict[str, Column], sums: dict[str, Column], *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``(field_name, key_value, task, sums...)``: one state per key and input task, combined inside the task."""
    k, s = [f"k{i}" for i in range(len(keys))], [f"s{i}" for i in range(len(sums))]
    staged = df.select(*[c.cast("string").alias(n) for n, c in zip(k, keys.values())], *[F.coalesce(c.cast("bigint"), F.lit(0)).alias(n) for n, c in zip(s, sums.values())])
    fields = list(keys)

    def chunk_state(t: pa.Table) -> pa.Table:
        each = [pa.table([pa.array([f] * len(t), pa.string()), t[n], *[t[x] for x in s]], names=["field_name", "key_value", *s]) for f, n in zip(fields, k)]
        return _merge([_merge([e], s) for e in each], s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, rows = _Tree(s, fan_in), [], 0
        for b in batches:
            t = pa.Table.from_batches([b])
            while rows + len(t) >= chunk_rows:
                head = t.slice(0, chunk_rows - rows)
                tree.add(chunk_state(pa.concat_tables([*held, head])))
                t, held, rows = t.slice(len(head)), [], 0
            held, rows = [*held, t], rows + len(t)
        if rows:
            tree.add(chunk_state(pa.concat_tables(held)))
        if (out := tree.root()) is not None:
            task = TaskContext.get().partitionId()
            yield from out.append_column("task", pa.array([task] * len(out), pa.int32())).combine_chunks().to_batches()

    schema = "field_name string, key_value string, " + "".join(f"{x} bigint, " for x in s) + "task int"
    return staged.mapInArrow(run, schema)


def tree_aggregate(df: DataFrame, keys: dict[str, Column], sums: dict[str, Column], *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Sum ``sums`` by every field of ``keys``; one row per ``(field_name, key_value)``.

    Each input task combines chunks of ``chunk_rows`` rows locally and merges their states ``fan_in`` at a time, so a task
    sends one state per key however many rows it has. The states of ``fan_in`` neighbouring tasks are then merged per
    round, as many rounds as the logarithm of the number of tasks: no merge ever takes more than ``fan_in`` states of a
    key, however hot. Only states are shuffled, and the input is read once.

    Null keys form one group with ``key_value`` null, and empty text is a key like any other; null sums count as
    0; an empty input gives no rows. Other columns of ``df``, whatever their names, are not looked at.
    """
    states = written(task_states(df, keys, sums, chunk_rows=chunk_rows, fan_in=fan_in), "tree-states")
    last = states.agg(F.max("task")).first()[0]
    s = [f"s{i}" for i in range(len(sums))]
    merged = [F.sum(x).alias(x) for x in s]
    left = 1 if last is None else last + 1
    while True:
        states = states.withColumn("task", (F.col("task") / fan_in).cast("int")).groupBy("field_name", "key_value", "task").agg(*merged)
        left = -(-left // fan_in)
        if left == 1:
            return states.select("field_name", "key_value", *[F.col(x).alias(n) for x, n in zip(s, sums)])


def frequent_keys(df: DataFrame, keys: Sequence[str], least_share: float) -> DataFrame:
    """``(field_name, key_value)`` of every non-null value in at least ``least_share`` of all rows of ``df``.

    The number of rows is the sum of one field's counts.
    """
    counts = written(tree_aggregate(df, {k: F.col(k) for k in keys}, {"n": F.lit(1)}), "tree-counts")
    total = counts.where(F.col("field_name") == keys[0]).agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("key_value").isNotNull() & (F.col("n") >= F.lit(least_share) * total)).select("field_name", "key_value")
