"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

#: Keys one bucket should hold; a bucket of both copies is one pair of Arrow tables in one task.
BUCKET_KEYS = 20_000

#: Differing records that are broadcast at most; keys are short, so this is some ten megabytes.
BROADCAST_KEYS = 200_000

OUT = "record_id string, difference string, left_value string, right_value string"


def text_value(c: Column) -> Column:
    """Text compared exactly, empty text as null."""
    return F.nullif(c.cast("string"), F.lit(""))


def instant_value(c: Column) -> Column:
    """An instant to the millisecond, from a timestamp."""
    return F.unix_millis(c.cast("timestamp")).cast("string")


_ISO = r"^\s*\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d*)?)?)?"
_ZONE = r"\s*(Z|z|UTC|GMT|[+-]\d{1,2}(:?\d{2})?)\s*$"


def instant_millis(c: Column) -> Column:
    """Milliseconds of text in an ISO spelling, UTC where it names no offset, whatever the session's zone; else null."""
    text = F.regexp_replace(c.cast("string"), ",(?=\\d)", ".")
    zoned = F.when(text.rlike(_ISO + _ZONE), text).when(text.rlike(r"\d:\d+(\.\d*)?\s*$"), F.concat(F.trim(text), F.lit("Z"))).otherwise(F.concat(F.trim(text), F.lit("T00:00:00Z")))
    return F.unix_millis(F.when(text.rlike(_ISO + r"(" + _ZONE + r"|\s*$)"), zoned).try_cast("timestamp"))


def instant_text(c: Column) -> Column:
    """An instant to the millisecond, from text in any ISO spelling; other text stays itself."""
    return F.coalesce(instant_millis(c).cast("string"), text_value(c))


def rounded_value(places: int) -> Callable[[Column], Column]:
    return lambda c: F.round(c.cast("double"), places).cast(f"decimal(30,{places})").cast("string")


def latest_version(df: DataFrame, key: str, order: Column, columns: Sequence[Column]) -> DataFrame:
    """One row per key: the version with the greatest ``order``; among ties the greatest row, so the result is fixed.

    Versions are combined before the shuffle, so a key with very many versions costs no more than any other.
    """
    packed = F.struct(order.alias("o"), *columns)
    return df.groupBy(F.col(key).alias("k")).agg(F.max(packed).alias("v")).select("k", "v.*").drop("o")


def _bucket_diff(names: Sequence[str], left_name: str, right_name: str) -> Callable:
    def diff(left: pa.Table, right: pa.Table) -> pa.Table:
        def ordered(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
            # a leading mark keeps a null key apart from every text
            keys = pc.if_else(pc.is_null(t["k"]), "", pc.binary_join_element_wise("=", t["k"], "", null_handling="replace"))
            order = pc.sort_indices(keys)
            return t.take(order), np.asarray(keys.take(order).to_pylist(), dtype=object)

        lt, lk = ordered(left)
        rt, rk = ordered(right)

        def find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(b, a) if len(b) else np.zeros(len(a), dtype=np.int64)
            inside = at < len(b)
            hit = np.zeros(len(a), dtype=bool)
            hit[inside] = b[at[inside]] == a[inside]
            return at, hit

        at, hit = find(lk, rk)
        _, back = find(rk, lk)
        ids, what, lv, rv = [], [], [], []

        def emit(keys: pa.ChunkedArray, name: str, a, b) -> None:
            if n := len(keys):
                ids.append(keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys)
                what.append(pa.array([name] * n, pa.string()))
                for to, x in ((lv, a), (rv, b)):
                    to.append(pa.nulls(n, pa.string()) if x is None else x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x)

        emit(lt["k"].filter(pa.array(~hit)), left_name, None, None)
        emit(rt["k"].filter(pa.array(~back)), right_name, None, None)
        both_l = lt.filter(pa.array(hit))
        both_r = rt.take(pa.array(at[hit], pa.int64()))
        for i, c in enumerate(names):
            a, b = both_l[f"v{i}"], both_r[f"v{i}"]
            mask = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            emit(both_l["k"].filter(mask), c, a.filter(mask), b.filter(mask))
        flat = lambda parts: pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        return pa.table({"record_id": flat(ids), "difference": flat(what), "left_value": flat(lv), "right_value": flat(rv)})

    return diff


def _suspects(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(k)`` of the records that are missing on one side or whose hashes differ; versions and rows stay where they are.

    Only the key, the order and two hashes of a row are shuffled, whatever its width.
    """
    def short(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c.startswith("v")]
        filled = lambda cs, none: F.xxhash64(F.lit(none), *[F.coalesce(c, F.lit(none)) for c in cs])  # noqa: E731  # nulls would leave no mark
        marked = df.select("k", "o", filled(rest, "\x00").alias("h"), filled(rest[::-1], "\x01").alias("h2"))
        return marked.groupBy("k").agg(F.max(F.struct("o", "h", "h2")).alias("m"))

    a, b = short(left).alias("a"), short(right).alias("b")
    both = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")), "full_outer")
    differs = F.col("a.m").isNull() | F.col("b.m").isNull() | (F.col("a.m.h") != F.col("b.m.h")) | (F.col("a.m.h2") != F.col("b.m.h2"))
    return both.where(differs).select(F.coalesce("a.k", "b.k").alias("k"))


def table_differences(
    left: DataFrame,
    right: DataFrame,
    *,
    key: str,
    values: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]],
    left_order: Column,
    right_order: Column,
    left_name: str,
    right_name: str,
    bucket_keys: int = BUCKET_KEYS,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """``(record_id, difference, left_value, right_value)``: one row per missing record and per differing field.

    ``values`` gives, for every compared column, how the left and the right copy turn it into comparable text.
    Row hashes of the newest versions are compared first, so that rows which are equal are never shuffled whole. Of
    the records that differ or are missing, the newest versions are cut into hash buckets of about ``bucket_keys`` keys,
    and the buckets are cogrouped as Arrow tables: keys align by sorted search, columns compare through null-aware
    masks, and only masked cells leave the task. Up to ``broadcast_keys`` such records are sent to where the rows are;
    more of them are joined by shuffling.

    A null key is a key of its own. Repeated keys count as versions; of versions of the same greatest order the greatest
    row counts, and those that differ in a hash are compared in full. Two nulls are equal. An empty copy makes
    every record of the other one missing. Columns not in ``values`` are ignored. Compared columns may have any names:
    they are ``v0``, ``v1``, ... until the output.
    """
    def form(df: DataFrame, order: Column, side: int) -> DataFrame:
        return df.select(F.col(key).alias("k"), order.alias("o"), *[f[side](F.col(c)).alias(f"v{i}") for i, (c, f) in enumerate(values.items())])

    a, b = form(left, left_order, 0), form(right, right_order, 1)
    suspects = written(_suspects(a, b), "differences-keys")
    n = suspects.count()
    few = suspects.select(F.col("k").alias("sk"))
    few = F.broadcast(few) if n <= broadcast_keys else few
    buckets = max(1, -(-n // bucket_keys))

    def cut(df: DataFrame) -> DataFrame:
        own = df.join(few, F.col("k").eqNullSafe(F.col("sk")), "left_semi")
        return latest_version(own, "k", F.col("o"), [F.col(c) for c in df.columns if c.startswith("v")]).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))

    inner = _bucket_diff(list(values), left_name, right_name)
    return cut(a).groupBy("bucket").cogroup(cut(b).groupBy("bucket")).applyInArrow(inner, schema=OUT)
