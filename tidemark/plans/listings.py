"""Observation histories: an order is an observation of its customer, a part a listing of its brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.relational import latest_by, top_k_per
from tidemark.session import table


def observations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("listing"), F.col("o_orderkey").alias("observation"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


def _history() -> Window:
    return Window.partitionBy("listing").orderBy("at", "observation")


def upper_median(c: Column) -> Column:
    """The element in the middle, of two the upper one."""
    return F.element_at(F.sort_array(F.collect_list(c)), (F.count(c) / 2).cast("int") + 1)


def f01_reductions(spark: SparkSession, d: str, days: int = 90) -> DataFrame:
    """Observations below the one before, of the last ``days`` days; missing prices leave before, the window after."""
    o = observations(spark, d).where("price is not null")
    o = o.withColumn("before", F.lag("price").over(_history()))
    end = o.agg(F.max("at").alias("end"))
    cut = o.crossJoin(end).where(F.col("at") >= F.col("end") - F.expr(f"interval {int(days)} days"))  # one row
    return cut.where("price < before").select("listing", "observation", F.round(F.col("before") - F.col("price"), 2).alias("reduction"), F.round((F.col("price") / F.col("before") - 1) * 100, 4).alias("change_pct"))


def f02_first_observations(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return o.groupBy("listing").agg(F.min_by("observation", F.struct("at", "observation")).alias("first"), F.count("*").alias("observations"))


def f03_latest_observations(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(observations(spark, d), ["listing"], [F.col("at"), F.col("observation")]).select("listing", "observation", "price", "status")


def f04_price_history(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).groupBy("listing").agg(F.array_sort(F.collect_list(F.struct("at", "observation", "price"))).alias("h"))
    return o.select("listing", F.array_join(F.transform("h", lambda x: F.format_string("%.2f", x["price"])), ",").alias("prices"))


def f05_days_on_market(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d).groupBy("listing").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    return o.select("listing", F.expr("timestampdiff(DAY, a, b)").alias("market_days"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    per = F.when(F.col("p_size") > 0, F.try_divide(F.col("p_retailprice"), F.col("p_size")))
    return p.select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice", per.alias("per_size"))


def e17_area_stats(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    g = _listings(spark, d).where("per_size is not null").groupBy("p_brand")
    s = g.agg(F.count("*").alias("n"), F.round(F.avg("per_size"), 6).alias("mean"), upper_median(F.col("per_size")).alias("median"), F.min("per_size").alias("low"), F.max("per_size").alias("high"))
    return s.where(F.col("n") >= least).withColumns({c: F.round(c, 6) for c in ("median", "low", "high")})


def e18_trends(spark: SparkSession, d: str, days: int = 365, least: int = 5) -> DataFrame:
    """Mean price of the later half of each listing's observations in the window against the earlier half."""
    o = observations(spark, d).where("price is not null")
    o = o.crossJoin(o.agg(F.max("at").alias("end"))).where(F.col("at") >= F.col("end") - F.expr(f"interval {int(days)} days"))  # one row
    o = o.withColumn("rn", F.row_number().over(_history())).withColumn("n", F.count("*").over(Window.partitionBy("listing"))).where(F.col("n") >= least)
    first = F.col("rn") <= F.expr("n div 2")
    h = o.groupBy("listing").agg(F.count("*").alias("n"), F.avg(F.when(first, F.col("price"))).alias("a"), F.avg(F.when(~first, F.col("price"))).alias("b"))
    return h.select("listing", "n", F.round("b", 4).alias("later_mean"), F.round((F.col("b") - F.col("a")) / F.nullif("a", F.lit(0.0)) * 100, 4).alias("change_pct"))


def e19_shared_galleries(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of name beginnings that listings of more than one brand share."""
    p = table(spark, d, "part").withColumn("gallery", F.substring(F.sha2(F.substring("p_name", 1, 4), 256), 1, 32))
    return p.groupBy("gallery").agg(F.count_distinct("p_brand").alias("brands"), F.count("*").alias("listings"), F.min("p_partkey").alias("first")).where("brands > 1")


def e20_reuse(spark: SparkSession, d: str, most: int = 5) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("lines")).where(F.col("parts") > most)


def e21_summary(spark: SparkSession, d: str) -> DataFrame:
    o = observations(spark, d)
    return o.agg(F.count("*").alias("observations"), F.count_distinct("listing").alias("listings"), F.min("at").cast("date").alias("first_day"), F.max("at").cast("date").alias("last_day"))


def e22_grid(spark: SparkSession, d: str) -> DataFrame:
    p = _listings(spark, d)
    return p.groupBy((F.floor(F.col("p_size") / 10) * 10).cast("int").alias("size_from"), (F.floor(F.col("p_retailprice") / 250) * 250).cast("int").alias("price_from")).agg(F.count("*").alias("listings"))


def e24_duplicates(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs")).withColumn("repeats", F.col("lines") - F.col("pairs"))


def e25_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Orders by priority with one column per status."""
    o = table(spark, d, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).select("o_orderpriority", *[F.coalesce(s, F.lit(0)).alias(f"status_{s.lower()}") for s in "FOP"])


def e26_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often each field of the archive has a value, one row per field."""
    n = table(spark, d, "nuggets")
    fields = ["category", "raw_text", "extracted_insight", "author", "community", "created_utc", "upvotes"]
    filled = n.agg(F.count("*").alias("kept"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(c) for c in fields])
    return filled.unpivot(["kept"], fields, "field", "covered").select("field", "covered", F.round(F.col("covered") / F.col("kept"), 6).alias("share"))


def d01_observed_listings(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("listing"), "c_nationkey")
    return observations(spark, d).join(c, "listing").groupBy("c_nationkey").agg(F.count("*").alias("observations"), F.round(F.sum("price"), 2).alias("value"))


def d02_unobserved_too(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("listing"), "c_mktsegment")
    return c.join(observations(spark, d), "listing", "left").groupBy("c_mktsegment").agg(F.count("observation").alias("observations"), F.count_if(F.col("observation").isNull()).alias("never_observed"))


def d11_against_market(spark: SparkSession, d: str) -> DataFrame:
    """Each part against the mean of its brand; more than 30 % below is flagged."""
    p = _listings(spark, d)
    mean = p.groupBy("p_brand").agg(F.avg("per_size").alias("mean"))
    against = (F.col("per_size") - F.col("mean")) / F.col("mean") * 100
    return p.join(mean, "p_brand").where("mean > 0 and per_size is not null").select("p_partkey", F.round(against, 4).alias("against_pct"), (against < -30).alias("suspicious"))


def d13_price_band(spark: SparkSession, d: str, share: float = 0.02, most: int = 200) -> DataFrame:
    """Parts of other brands and the same type within ``share`` of the price; the first ``most`` by key.

    A price's range is made of few nodes of a binary tree over whole numbers and the gaps between them. Each node keeps
    the first parts by key that a part of any brand could need, each range those of its nodes, and each part takes its
    own from its range's, so the work grows with parts and answers and not with the parts of a price.
    """
    p = table(spark, d, "part").where("p_type is not null and p_brand is not null")
    lo, hi = (F.col("p_retailprice") * (1 - share)).cast("bigint"), (F.col("p_retailprice") * (1 + share)).cast("bigint")
    left = p.where("p_retailprice > 0").select("p_partkey", "p_brand", "p_type", lo.alias("lo"), hi.alias("hi"))
    ranges = left.select("p_type", "lo", "hi").distinct()
    widest = ranges.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit((2 * widest + 1).bit_length() - 1))
    right = p.where("p_retailprice >= 0").select(F.col("p_partkey").alias("other"), F.col("p_brand").alias("brand2"), "p_type", (F.floor("p_retailprice") * 2 + (F.col("p_retailprice") > F.floor("p_retailprice")).cast("bigint")).alias("cell"))
    nodes = right.withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(cell, level)")).drop("cell")
    nodes = _first_of_other_brands(nodes, ["p_type", "level", "node"], most)
    ends = ranges.withColumn("level", F.explode(levels)).withColumn("a", F.expr("shiftright(2 * lo + shiftleft(1L, level) - 1, level)")).withColumn("b", F.expr("shiftright(2 * hi + 1, level)")).where("a < b")
    cover = ends.withColumn("node", F.explode(F.array_compact(F.array(F.expr("if(a % 2 = 1, a, null)"), F.expr("if(b % 2 = 1, b - 1, null)")))))
    near = _first_of_other_brands(cover.select("p_type", "lo", "hi", "level", "node").join(nodes.drop("place"), ["p_type", "level", "node"]).drop("level", "node"), ["p_type", "lo", "hi"], most)
    around = near.groupBy("p_type", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("place", "other", "brand2"))).alias("around"))
    kinds = left.select("p_type", "lo", "hi", "p_brand").distinct().join(around, ["p_type", "lo", "hi"])
    own = F.slice(F.filter("around", lambda x: x["brand2"] != F.col("p_brand")), 1, most)
    kinds = kinds.select("p_type", "lo", "hi", "p_brand", F.transform(own, lambda x: x["other"]).alias("others"))
    left = left.withColumn("rows", F.count("*").over(Window.partitionBy("p_partkey")))
    out = left.join(kinds, ["p_type", "lo", "hi", "p_brand"]).select("p_partkey", "rows", F.explode("others").alias("other"))
    again = top_k_per(out.where("rows > 1"), ["p_partkey"], [F.asc_nulls_last("other")], most)  # several rows of one key share its number
    return out.where("rows = 1").select("p_partkey", "other").unionByName(again.select("p_partkey", "other"))


def _first_of_other_brands(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Of each key the rows with ``place`` that are among the first ``k`` by ``other`` once any one brand is left out: at most 2 ``k``."""
    order = [F.asc_nulls_last("other"), F.asc("brand2")]
    df = top_k_per(df, [*keys, "brand2"], order, k, "of_brand")
    w = Window.partitionBy(*keys).orderBy(*order)
    most_of_one = F.max("of_brand").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("place", F.row_number().over(w)).withColumn("most_of_one", most_of_one).where(F.col("place") - F.col("most_of_one") <= k).drop("of_brand", "most_of_one")


def j06_pacific_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Los_Angeles")).alias("day")).agg(F.count("*").alias("events"))


def j12_per_size(spark: SparkSession, d: str) -> DataFrame:
    return _listings(spark, d).select("p_partkey", F.round("per_size", 6).alias("per_size"))


def m12_rolling_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Each event's value against the mean of all earlier events of its type and user."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.round("value", 4).alias("value"), F.round(F.avg("value").over(w), 7).alias("baseline"))


def l12_event_windows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return e.select(F.to_date("w.start").alias("day"), "event_type", "events", "value")


def j20_props(spark: SparkSession, d: str) -> DataFrame:
    """The number inside each event's JSON, summed by type; unreadable JSON counts as missing."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(k), 4).alias("total"), F.count_if(k.isNull()).alias("missing"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_O = "o as (select o_custkey listing, o_orderkey observation, o_orderdate t, o_totalprice price, o_orderstatus status from orders)"
_P = "p as (select *, case when p_size > 0 then p_retailprice / p_size end per_size from part)"
ORACLE = {
    "f01_reductions": f"with {_O}, l as (select *, lag(price) over (partition by listing order by t, observation) before from o where price is not null) select listing, observation, round(before - price, 2) reduction, round((price / before - 1) * 100, 4) change_pct from l where price < before and t >= (select max(t) from o) - interval 90 day",
    "f02_first_observations": f"with {_O} select listing, arg_min(observation, (t, observation)) first, count(*) observations from o group by listing",
    "f03_latest_observations": f"with {_O} select listing, observation, price, status from o qualify row_number() over (partition by listing order by t desc, observation desc) = 1",
    "f04_price_history": f"with {_O} select listing, string_agg(printf('%.2f', price), ',' order by t, observation) prices from o group by listing",
    "f05_days_on_market": f"with {_O} select listing, (epoch_ms(max(t)) - epoch_ms(min(t))) // 86400000 market_days from o group by listing",
    "e17_area_stats": f"with {_P} select p_brand, count(*) n, round(avg(per_size), 6) mean, round(list_sort(list(per_size))[len(list(per_size)) // 2 + 1], 6) as median, round(min(per_size), 6) low, round(max(per_size), 6) high from p where per_size is not null group by p_brand having count(*) >= 3",
    "e18_trends": f"with {_O}, w as (select * from o where price is not null and t >= (select max(t) from o) - interval 365 day), r as (select *, row_number() over (partition by listing order by t, observation) rn, count(*) over (partition by listing) n from w), h as (select listing, count(*) n, avg(price) filter (rn <= n // 2) a, avg(price) filter (rn > n // 2) b from r where n >= 5 group by listing) select listing, n, round(b, 4) later_mean, round((b - a) / nullif(a, 0) * 100, 4) change_pct from h",
    "e19_shared_galleries": "select substr(sha256(substr(p_name, 1, 4)), 1, 32) gallery, count(distinct p_brand) brands, count(*) listings, min(p_partkey) first from part group by 1 having count(distinct p_brand) > 1",
    "e20_reuse": "select l_suppkey, count(distinct l_partkey) parts, count(*) as lines from lineitem group by 1 having count(distinct l_partkey) > 5",
    "e21_summary": f"with {_O} select count(*) observations, count(distinct listing) listings, cast(min(t) as date) first_day, cast(max(t) as date) last_day from o",
    "e22_grid": "select cast(floor(p_size / 10) * 10 as integer) size_from, cast(floor(p_retailprice / 250) * 250 as integer) price_from, count(*) listings from part group by all",
    "e24_duplicates": "select l_returnflag, count(*) as lines, count(distinct (l_partkey, l_suppkey)) pairs, count(*) - count(distinct (l_partkey, l_suppkey)) repeats from lineitem group by 1",
    "e25_histogram": "select o_orderpriority, count(*) filter (o_orderstatus = 'F') status_f, count(*) filter (o_orderstatus = 'O') status_o, count(*) filter (o_orderstatus = 'P') status_p from orders group by 1",
    "e26_coverage": " union all ".join(f"select '{c}' field, count(*) filter (coalesce({c}::varchar, '') <> '') covered, round(count(*) filter (coalesce({c}::varchar, '') <> '') / count(*), 6) share from nuggets" for c in ["category", "raw_text", "extracted_insight", "author", "community", "created_utc", "upvotes"]),
    "d01_observed_listings": "select c_nationkey, count(*) observations, round(sum(o_totalprice), 2) as value from orders join customer on o_custkey = c_custkey group by 1",
    "d02_unobserved_too": "select c_mktsegment, count(o_orderkey) observations, count(*) filter (o_orderkey is null) never_observed from customer left join orders on o_custkey = c_custkey group by 1",
    "d11_against_market": f"with {_P}, m as (select p_brand, avg(per_size) mean from p group by 1) select p_partkey, round((per_size - mean) / mean * 100, 4) against_pct, (per_size - mean) / mean * 100 < -30 suspicious from p join m using (p_brand) where mean > 0 and per_size is not null",
    "d13_price_band": "select a.p_partkey, b.p_partkey other from part a join part b on a.p_type = b.p_type and a.p_brand <> b.p_brand where a.p_retailprice > 0 and b.p_retailprice >= cast(trunc(a.p_retailprice * 0.98) as bigint) and b.p_retailprice <= cast(trunc(a.p_retailprice * 1.02) as bigint) qualify row_number() over (partition by a.p_partkey order by b.p_partkey) <= 200",
    "j06_pacific_days": "select cast((ts at time zone 'UTC') at time zone 'America/Los_Angeles' as date) as day, count(*) events from events group by 1",
    "j12_per_size": f"with {_P} select p_partkey, round(per_size, 6) per_size from p",
    "m12_rolling_baseline": "select event_id, round(value, 4) as value, round(avg(value) over (partition by user_id, event_type order by ts, event_id rows between unbounded preceding and 1 preceding), 7) baseline from events",
    "l12_event_windows": "select cast(ts as date) as day, event_type, count(*) events, round(sum(value), 4) as value from events group by all",
    "j20_props": "select event_type, round(sum(try_cast(json_extract_string(props, '$.k') as double)), 4) total, count(*) filter (try_cast(json_extract_string(props, '$.k') as double) is null) missing from events group by 1",
}
