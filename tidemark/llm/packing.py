"""Items of varying length into containers of fixed capacity, planned on the histogram of lengths.

The plan never looks at single items: a dynamic programme over the global histogram chooses the bucket boundaries that
cost the least padding, batches of a token budget form inside each bucket, from the longest down, and the room a batch
leaves is topped up with the longest shorter length that fits. The plan has at most a few entries per distinct length,
and lengths are at most the capacity, so it is small however many items there are. Items then take places by their
rank within their length, which is counted in parallel.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shuffle_width, written

BUCKETS = 16


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding of items to their bucket's bound.

    Exact dynamic programme over the distinct lengths, which ascend; splits of equal cost take the smallest.
    """
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    s = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    cost = c[1:] * lengths - s[1:]  # one bucket for the first j+1 lengths
    back = []
    for _ in range(1, min(buckets, n)):
        new, frm = cost.copy(), np.zeros(n, np.int64)
        for j in range(1, n):
            # the last bucket begins after length i
            i = np.arange(j)
            option = cost[:j] + (c[j + 1] - c[i + 1]) * lengths[j] - (s[j + 1] - s[i + 1])
            k = int(option.argmin())
            if option[k] < new[j]:
                new[j], frm[j] = option[k], k + 1
        back.append(frm)
        cost = new
    bounds, j = [], n - 1
    for frm in reversed(back):
        bounds.append(int(lengths[j]))
        if frm[j] == 0:
            return bounds[::-1]
        j = int(frm[j]) - 1
    bounds.append(int(lengths[j]))
    return bounds[::-1]


def plan(lengths: list[int], counts: list[int], capacity: int, buckets: int = BUCKETS) -> tuple[list[int], list[tuple[int, list[tuple[int, int]]]]]:
    """Bucket bounds, and kinds of containers as (number of them, [(length, items of it in each)]).

    Every kind uses up at least one length or its remainder, so there are at most about twice as many kinds as lengths.
    """
    left = {int(x): int(n) for x, n in zip(lengths, counts) if n > 0}
    order = sorted(left)
    bounds = bucket_bounds(np.array(order), np.array([left[x] for x in order]), buckets)
    kinds = []
    while order:
        room, content, top = capacity, [], len(order)
        while room > 0 and (top := bisect_right(order, room, 0, top)):
            x = order[top - 1]
            n = min(left[x], room // x)
            # the longest that fits: lengths of the bucket first, shorter ones top the batch up
            content.append((x, n))
            room -= n * x
            top -= 1
        times = min(left[x] // n for x, n in content)
        kinds.append((times, content))
        for x, n in content:
            left[x] -= times * n
            if not left[x]:
                order.remove(x)
    return bounds, kinds


def pack(items: DataFrame, capacity: int, *, buckets: int = BUCKETS) -> DataFrame:
    """``(id, piece, tokens, bucket, container)`` of ``items`` (id, tokens); every item is in exactly one container.

    Only items longer than ``capacity`` are split: into pieces that fill a container each and one rest. ``bucket`` is
    the upper bound of the item's length bucket. Items without tokens (0 or null) take no room and get container and
    bucket null. Containers are numbered from 0. Repeated ids are separate items; other columns are not read.
    """
    spark, full = items.sparkSession, F.lit(capacity)
    sized = items.select("id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    pieces = sized.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("tokens") / full).cast("int") - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("id", "piece", F.least(F.col("tokens") - F.col("piece") * full, full).cast("int").alias("tokens"))
    salts = shuffle_width(spark)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counted = written(pieces.groupBy("tokens", "salt").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["tokens"]: r["n"] for r in counted.groupBy("tokens").agg(F.sum("n").alias("n")).where("tokens > 0").collect()}
    lengths = sorted(histogram)
    bounds, kinds = plan(lengths, [histogram[x] for x in lengths], capacity, buckets)

    slots, used, first = [], dict.fromkeys(lengths, 0), 0
    for times, content in kinds:
        for x, n in content:
            slots.append((x, used[x], used[x] + times * n, first, n))
            used[x] += times * n
        first += times
    table = spark.createDataFrame(slots, "tokens int, lo bigint, hi bigint, first bigint, each bigint")
    named = spark.createDataFrame([(x, next(b for b in bounds if b >= x)) for x in lengths], "tokens int, bucket int")

    # rank within a length: rows of the salts before, then the row's place in its own salt
    before = counted.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("tokens", "salt", "base")
    ranked = pieces.withColumn("place", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("id", "piece")) - 1).join(before, ["tokens", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("place"))
    starts = F.broadcast(table.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each"))).alias("slots")).join(named, "tokens"))  # bounded by the capacity
    slot = F.element_at(F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"])), 1)
    out = ranked.where("tokens > 0").join(starts, "tokens").withColumn("s", slot)
    out = out.select("id", "piece", "tokens", "bucket", (F.col("s.first") + F.floor((F.col("rank") - F.col("s.lo")) / F.col("s.each"))).cast("bigint").alias("container"))
    none = sized.where("tokens = 0").select("id", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("bigint").alias("container"))
    return out.unionByName(none)
