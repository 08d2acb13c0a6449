"""Relational building blocks the plans share: newest version, top k, first wins, keyed merge, budgets, streaks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty_as_null(c: Column | str) -> Column:
    """Empty text and null are one missing value."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key with the greatest ``order``; among equal orders the greatest row, so the result is fixed.

    One aggregation: versions are combined before the shuffle, so a key with very many versions is no hot task.
    """
    rest = [c for c in df.columns if c not in key]
    packed = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*key).agg(F.max(packed).alias("v"))
    return best.select(*key, *[F.col(f"v.v{i}").alias(c) for i, c in enumerate(rest)])


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``; Spark limits each group before the shuffle as well."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_wins(df: DataFrame, key: Column, order: Sequence[Column], record_id: str) -> DataFrame:
    """Every row with ``kept_id``, the id of the first row of its key; rows with a blank key keep themselves.

    Rows without a key would all meet in one task, so they are given keys of their own.
    """
    blank = F.coalesce(key, F.lit("")) == ""
    own = F.when(blank, F.concat(F.lit("\x00"), F.col(record_id).cast("string"))).otherwise(key)
    first = df.withColumn("__k", own).groupBy("__k").agg(F.min_by(F.col(record_id), F.struct(*order)).alias("kept_id"))
    return df.withColumn("__k", own).join(first, "__k").drop("__k")


def running_budget(df: DataFrame, size: Column, order: Sequence[str], budget: int, slices: int = 64) -> DataFrame:
    """Whole rows in ``order`` until the sizes before them reach ``budget``; the row that crosses it is taken.

    The order is cut into ranges first and only the sums of the ranges pass through one task, so no task sorts all
    rows.
    """
    sized = df.withColumn("__n", F.coalesce(size.cast("bigint"), F.lit(0))).repartitionByRange(slices, *order).withColumn("__part", F.spark_partition_id())
    sums = sized.groupBy("__part").agg(F.sum("__n").alias("__sum"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("__n").over(inside), F.lit(0)) + F.col("__base")
    return sized.join(F.broadcast(base.select("__part", "__base")), "__part").withColumn("__before", before).where(F.col("__before") < budget).drop("__n", "__part", "__base", "__before")


def keyed_merge(current: DataFrame, incoming: DataFrame, key: str, compared: Sequence[str]) -> DataFrame:
    """``(key, change)`` for every key of both sides: new, seen_again, edited or absent, by one full outer join.

    Null and empty text are equal. ``edited`` means that one of ``compared`` differs.
    """
    a = current.select(F.col(key), F.struct(*[empty_as_null(c).alias(c) for c in compared]).alias("old"))
    b = incoming.select(F.col(key), F.struct(*[empty_as_null(c).alias(c) for c in compared]).alias("new"))
    differs = reduce(lambda x, y: x | y, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in compared])
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "absent").when(differs, "edited").otherwise("seen_again")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: Column) -> DataFrame:
    """Per key, how many of the newest rows in ``order`` (newest first) have ``flag`` before the first that has not."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__clear", F.sum(F.when(F.coalesce(flag, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys).agg(F.count_if(F.col("__clear") == 0).alias("streak"))


def zero_filled_days(counts: DataFrame, day: str, values: Sequence[str]) -> DataFrame:
    """One row per day from the first to the last of ``counts``, missing days with zeros."""
    calendar = counts.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias(day))
    return calendar.join(counts, day, "left").select(day, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])
