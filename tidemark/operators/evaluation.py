"""Evaluation metrics as aggregates: agreement, errors, confusion counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cohens_kappa(df: DataFrame, a: Column, b: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, agreement, kappa)`` of two yes/no ratings; null where only one class occurs. Null ratings are left out."""
    r = df.where(a.isNotNull() & b.isNotNull()).select(*by, a.cast("double").alias("a"), b.cast("double").alias("b"))
    g = r.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("o"), F.avg("a").alias("pa"), F.avg("b").alias("pb"))
    expected = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(expected < 1, (F.col("o") - expected) / (1 - expected))
    return g.select(*by, "n", F.round("o", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def mean_absolute_error(df: DataFrame, axes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``(axis, n, mae)`` of two numbers per row and axis; a row counts on the axes where it has both."""
    each = F.array(*[F.struct(F.lit(k).alias("axis"), F.abs(x.cast("double") - y.cast("double")).alias("error")) for k, (x, y) in axes.items()])
    return df.select(F.inline(each)).groupBy("axis").agg(F.count("error").alias("n"), F.round(F.avg("error"), 6).alias("mae"))


def precision_recall(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., tp, fp, fn, precision, recall, f1)``; a ratio with nothing below is null, F1 of nothing is 0."""
    p, t = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    c = df.groupBy(*by).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    ratio = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"))
