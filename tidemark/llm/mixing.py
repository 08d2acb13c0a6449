"""Documents of several sources mixed to target shares of all tokens, by a min-cost flow over membership patterns.

Texts are aggregated by the set of sources they occur in (their pattern). The flow sends token capacity from patterns to
the sources' quotas; the r-th use of a pattern's tokens costs more than the one before, so repetition is spread evenly
and texts of several sources go where they are needed. Within a pattern, texts stand on a line in seeded order and
each source takes an interval of it, wrapped around as often as it repeats; what a text is used follows from its place.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import shuffle_width, written


def min_cost_flow(edges: list[tuple[int, int, int, int]], start: int, end: int) -> list[int]:
    """Flow on each edge ``(from, to, capacity, cost)`` of the greatest flow at the least cost; costs are not negative.

    Successive shortest paths with potentials.
    """
    graph: dict[int, list[int]] = {}
    to, room, cost = [], [], []
    for a, b, c, w in edges:
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            graph.setdefault(x, []).append(len(to))
            graph.setdefault(y, [])
            to.append(y), room.append(r), cost.append(k)
    potential = dict.fromkeys(graph, 0)
    while True:
        dist, via, heap = {start: 0}, {}, [(0, start)]
        while heap:
            d, x = heappop(heap)
            if d > dist[x]:
                continue
            for e in graph.get(x, ()):
                if room[e] and (n := d + cost[e] + potential[x] - potential[to[e]]) < dist.get(to[e], n + 1):
                    dist[to[e]], via[to[e]] = n, e
                    heappush(heap, (n, to[e]))
        if end not in dist:
            return [room[2 * i + 1] for i in range(len(edges))]
        for x in potential:
            potential[x] += dist.get(x, dist[end])
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most


def quotas(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens each source takes of each pattern."""
    whole = sum(s for s, _ in targets.values()) or 1.0
    node = {x: i + 2 for i, x in enumerate([*patterns, *targets])}
    edges, flows = [], {}
    for p, n in patterns.items():
        for r in range(max(targets[s][1] for s in p)):
            edges.append((0, node[p], n, r))
        for s in p:
            flows[p, s] = len(edges)
            edges.append((node[p], node[s], n * targets[s][1], 0))
    for s, (share, _) in targets.items():
        edges.append((node[s], 1, round(total * share / whole), 0))
    used = min_cost_flow(edges, 0, 1)
    return {k: used[i] for k, i in flows.items() if used[i]}


def mix(items: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The selection ``(source, id, tokens, repeats)`` and the shares reached, one row per target source.

    ``items`` is (id, source, text_key, tokens), ``targets`` (source, target_share, max_repeats). ``total_tokens`` is
    the size of the mix, by default the tokens of all different texts of the target sources. Shares are scaled to sum
    to 1. A source whose texts, each used ``max_repeats`` times, do not fill its quota gives all it has, and its
    share falls short. Copies of one text in one source are one document, that of the smallest id, so copies cannot
    slip past the cap. Texts without tokens, rows of other or null sources and targets without a positive share or
    cap are left out. The same seed gives the same selection, whatever the partitioning.
    """
    spark = items.sparkSession
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}  # the fixed list of targets
    own = items.where(F.col("source").isin(list(wanted)) & (F.col("tokens") > 0))
    by_text = own.groupBy("text_key", "source").agg(F.min("id").alias("id"), F.max("tokens").alias("tokens"))
    by_text = by_text.groupBy("text_key").agg(F.max("tokens").alias("tokens"), F.sort_array(F.collect_list(F.struct("source", "id"))).alias("of"))
    slices = max(16, shuffle_width(spark))
    spot = F.xxhash64(F.lit(seed), "text_key")
    texts = written(by_text.select("text_key", "tokens", "of", F.array_join(F.transform("of", lambda x: x["source"]), "\n").alias("pattern"), spot.alias("spot"), F.pmod(spot, F.lit(slices)).cast("int").alias("slice")), "mixing-texts")
    sums = texts.groupBy("pattern", "slice").agg(F.sum("tokens").alias("n"))
    sums = written(sums.withColumn("base", F.sum("n").over(Window.partitionBy("pattern").orderBy("slice")) - F.col("n")), "mixing-sums")
    patterns = {tuple(r["pattern"].split("\n")): r["n"] for r in sums.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}  # at most 2^sources rows

    total = sum(patterns.values()) if total_tokens is None else total_tokens
    taken = quotas(patterns, wanted, total)
    at: dict[tuple[str, ...], int] = {}
    lines = []
    for (p, s), f in taken.items():
        lines.append(("\n".join(p), s, patterns[p], at.get(p, 0), at.get(p, 0) + f))
        at[p] = at.get(p, 0) + f
    plan = spark.createDataFrame(lines, "pattern string, source string, n bigint, lo bigint, hi bigint")

    place = F.sum("tokens").over(Window.partitionBy("pattern", "slice").orderBy("spot", "text_key")) - F.col("tokens")
    placed = texts.withColumn("place", place).join(sums.select("pattern", "slice", "base"), ["pattern", "slice"]).withColumn("at", F.col("base") + F.col("place"))
    uses = placed.join(F.broadcast(plan), "pattern")  # at most sources x 2^sources rows
    upto = lambda c: F.greatest(F.ceil((F.col(c) - F.col("at")) / F.col("n")), F.lit(0))  # noqa: E731  # rounds that begin before c
    uses = uses.withColumn("repeats", (upto("hi") - upto("lo")).cast("int")).where("repeats > 0")
    doc = F.element_at(F.filter("of", lambda x: x["source"] == F.col("source")), 1)["id"]
    selection = uses.select("source", doc.alias("id"), "tokens", "repeats")

    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("selected_tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    have = own.groupBy("source", "text_key").agg(F.max("tokens").alias("tokens")).groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    shares = targets.join(have, "source", "left").join(got, "source", "left")
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("available_tokens", "selected_tokens", "documents", "most_repeats")]
    actual = F.round(F.try_divide(F.coalesce("selected_tokens", F.lit(0)), F.sum("selected_tokens").over(Window.partitionBy())), 6).alias("actual_share")
    return selection, shares.select("source", "target_share", "max_repeats", *filled, actual)
