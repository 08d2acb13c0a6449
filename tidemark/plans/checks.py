"""Quality gates, alarms, evidence, entity resolution, place words, quotes and priorities over the tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.relational import top_k_per
from tidemark.operators.vectors import first_after
from tidemark.plans.listings import d13_price_band
from tidemark.plans.signals import newest
from tidemark.plans.vectors import band_pairs, hashed_parts, near_hashes
from tidemark.session import shuffle_width, table

#: Least share of rows with a value, per field, and least rows for a verdict. Parameters.
FLOORS = {"category": 0.9, "extracted_insight": 0.85, "author": 0.8, "community": 0.5, "created_utc": 0.9}
QUORUM = 20


def e23_gates(spark: SparkSession, d: str) -> DataFrame:
    """Per platform and field: the share of rows with a value against its floor; few rows are thin, no value at all is none."""
    n = table(spark, d, "nuggets")
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("gate"), F.lit(f).alias("floor"), (F.coalesce(F.col(c), F.lit("")) != "").alias("has")) for c, f in FLOORS.items()]))
    g = n.select("platform", each).groupBy("platform", "gate", "floor").agg(F.count("*").alias("n"), F.avg(F.col("has").cast("double")).alias("share"))
    verdict = F.when(F.col("n") < QUORUM, "thin").when(F.col("share") == 0, "none").when(F.col("share") >= F.col("floor"), "ok").otherwise("fail")
    return g.select("platform", "gate", "n", F.round("share", 6).alias("share"), verdict.alias("verdict"))


def e27_merged_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every batch added up per platform, its statuses as a map of sums."""
    b = table(spark, d, "ingest_batch").groupBy("platform", "status").agg(F.count("*").alias("n"), F.sum("attempts").alias("attempts"))
    m = b.groupBy("platform").agg(F.sum("n").alias("batches"), F.sum("attempts").alias("attempts"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "n"))), ",").alias("by_status"))
    return m


def e35_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Alarms of each source's newest batches: the newest failed after one that did not, three failures in a row, or nothing where there was something."""
    b = table(spark, d, "ingest_batch").where("source is not null").select("source", "id", (F.col("status") == "failed").alias("bad"), F.coalesce(F.json_array_length("comments"), F.lit(0)).alias("n"))
    r = top_k_per(b, ["source"], [F.desc("id")], 10)
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    s = r.groupBy("source").agg(at(1, "bad").alias("b1"), at(2, "bad").alias("b2"), at(3, "bad").alias("b3"), at(1, "n").alias("n1"), F.max(F.when(F.col("rank") > 1, F.col("n"))).alias("before"))
    kinds = F.array_compact(F.array(F.when(F.col("b1") & ~F.coalesce("b2", F.lit(True)), "newly_failed"), F.when(F.col("b1") & F.col("b2") & F.col("b3"), "repeat_failure"), F.when((F.col("n1") == 0) & ~F.col("b1") & (F.coalesce("before", F.lit(0)) > 0), "shape_gone")))
    return s.select("source", F.explode(kinds).alias("alarm"))


def e47_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each run collected, with its status."""
    s = newest(spark, d)
    g = s.groupBy("run_id").agg(F.count("*").alias("collected"), F.coalesce(F.sum("relevant"), F.lit(0)).alias("relevant"), F.count_if(F.col("audience") == "buyer").alias("buyer"), F.count_if(F.col("run_status") != "ok").alias("errors"), F.count_if(F.col("edited_utc").isNotNull()).alias("edited"))
    return g.withColumn("status", F.when(F.col("errors") == 0, "ok").when(F.col("errors") < F.col("collected"), "partial").otherwise("error"))


def e48_evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nuggets").where("source_url is not null").groupBy("source_url", "platform").agg(F.count("*").alias("citations")).where("citations > 1")


def e51_run_flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of each run of the archive: all trivial, one platform only, nothing with an insight."""
    g = table(spark, d, "nuggets").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("trivial") == 1).alias("t"), F.count_distinct("platform").alias("p"), F.count("extracted_insight").alias("i"))
    flags = F.array_compact(F.array(F.when(F.col("t") == F.col("n"), "all_trivial"), F.when((F.col("p") == 1) & (F.col("n") >= 3), "one_platform"), F.when(F.col("i") == 0, "no_insight")))
    return g.select("run_id", F.explode(flags).alias("flag"))


def f10_source_status(spark: SparkSession, d: str) -> DataFrame:
    """Each platform as fresh, stale or silent: its last batch against three times its longest usual gap."""
    b = table(spark, d, "ingest_batch").where("platform is not null").select("platform", F.unix_seconds(F.col("created_at").try_cast("timestamp")).alias("at")).where("at is not null")
    gaps = b.withColumn("gap", F.col("at") - F.lag("at").over(Window.partitionBy("platform").orderBy("at")))
    s = gaps.groupBy("platform").agg(F.max("at").alias("last"), F.max("gap").alias("gap"), F.count("*").alias("n"))
    s = s.crossJoin(b.agg(F.max("at").alias("now")))  # one row
    age = F.col("now") - F.col("last")
    return s.select("platform", "n", F.when(F.col("gap").isNull(), "unknown").when(age <= F.col("gap"), "fresh").when(age <= 3 * F.col("gap"), "stale").otherwise("silent").alias("state"))


def f14_newest_graded(spark: SparkSession, d: str) -> DataFrame:
    """Per app, the verdict of its newest scored review; an unscored newer one does not clear it."""
    score = T.number_or_text(F.col("weighted_vote_score"))
    r = table(spark, d, "mixed_vote_score").withColumn("s", score).where("s is not null")
    g = r.groupBy("app_id").agg(F.max(F.struct("timestamp_updated", "recommendationid", "s")).alias("x"))
    return g.select("app_id", F.col("x.recommendationid").alias("recommendationid"), (F.col("x.s") < 0.5).alias("alarm"))


def g07_rescore_queue(spark: SparkSession, d: str, limit: int = 50) -> DataFrame:
    """Batches to try again, the least tried first."""
    b = table(spark, d, "ingest_batch").where("status in ('failed', 'claimed')")
    return b.orderBy(F.asc_nulls_first("attempts"), "id").limit(limit).select("id", "attempts", "platform")


def g02_page(spark: SparkSession, d: str, limit: int = 25, offset: int = 50) -> DataFrame:
    return newest(spark, d).orderBy(F.desc("first_seen_utc"), "record_id").offset(offset).limit(limit).select("record_id", "community")


def _best_of_bands(parts: DataFrame, most: int = 12) -> DataFrame:
    """``(p_partkey, other)``: of the pairs of ``d12_band_join`` those that can be a part's best with a score of 0.5.

    Without type and size in common a pair scores 0.375 at most. Of a near hash's later parts that agree in type or
    size, perhaps in the other and in price too, the first by key stands for all: they score alike, or better. Keys of
    several rows are scored by every row, so their pairs are all taken.
    """
    rows = parts.where("p_partkey is not null").groupBy("p_partkey").count()
    single, several = rows.where("count = 1").select("p_partkey"), rows.where("count > 1").select("p_partkey")
    h = F.substring(F.sha2("p_name", 256), 1, 16)
    p = parts.where("p_brand is not null").join(single, "p_partkey").select("p_partkey", "p_brand", "p_retailprice", F.coalesce("p_size", F.lit(0)).cast("bigint").alias("size"), F.col("p_size").isNotNull().alias("sized"), h.alias("h"), F.expr("inline(array(struct('t' as kind, p_type as same), struct('s' as kind, string(p_size) as same)))")).where("h is not null and same is not null")
    keys, width = ["h2", "kind", "same"], shuffle_width(parts.sparkSession)
    asked = p.join(near_hashes(p, most).drop("bits"), "h").drop("h").repartition(width, *keys)
    base = p.withColumnRenamed("h", "h2")
    base = base.select(*[F.col(c).alias(f"y_{c}") for c in base.columns]).repartition(width, *[f"y_{k}" for k in keys])

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        if len(x) and len(y):
            y = y.rename_columns([c.removeprefix("y_") for c in y.column_names]).sort_by("p_partkey")
            key, other = x["p_partkey"].to_numpy(), y["p_partkey"].to_numpy()
            brand = np.unique(np.concatenate((x["p_brand"].to_numpy(), y["p_brand"].to_numpy())), return_inverse=True)[1]
            price, theirs = (t["p_retailprice"].to_numpy().astype(np.float64) for t in (x, y))
            known = np.unique(theirs[~np.isnan(theirs)])
            span = len(known) + 1  # a place beyond the prices for none
            place = np.where(np.isnan(theirs), len(known), np.searchsorted(known, theirs))
            lo, hi = _within(price, known)
            at, every = np.searchsorted(other, key, "right"), np.zeros(len(x), np.int64)
            sizes = np.unique(np.concatenate((x["size"].to_numpy(), y["size"].to_numpy())), return_inverse=True)[1]
            sized, none = x["sized"].to_numpy(), np.zeros(len(y), np.int64)
            asks = [(every, none, np.ones(len(x), bool))]
            if x["kind"][0].as_py() == "t":
                asks.append((sizes[: len(x)] * 2 + 1, sizes[len(x) :] * 2 + y["sized"].to_numpy(), sized))
            for mine, group, ok in asks:
                for a, z in ((every, every + span), (lo, hi)):
                    i = np.flatnonzero(ok)
                    j = first_after(at[i], mine[i] * span + a[i], mine[i] * span + z[i], brand[: len(x)][i], group * span + place, brand[len(x) :])
                    pairs.append((key[i[j >= 0]], other[j[j >= 0]]))
        k, o = (np.concatenate([p[n] for p in pairs]) if pairs else np.zeros(0, np.int64) for n in (0, 1))
        return pa.table({"p_partkey": pa.array(k, pa.int64()), "other": pa.array(o, pa.int64())})

    best = asked.groupBy(*keys).cogroup(base.groupBy(*[f"y_{k}" for k in keys])).applyInArrow(meet, "p_partkey bigint, other bigint")
    if several.isEmpty():
        return best
    every = hashed_parts(parts)
    few = every.join(several, "p_partkey", "left_semi")
    return reduce(DataFrame.unionByName, [best, *[band_pairs(a, b, most).select("p_partkey", F.col("k2").alias("other")) for a, b in ((few, every), (every, few))]])


def _within(price: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range in the sorted ``known`` of what is within 2 % of each price, by the very comparison of the score."""
    lo, hi = np.searchsorted(known, price * 0.98), np.searchsorted(known, price * 1.02, "right")
    near = lambda at: (at >= 0) & (at < len(known)) & (np.abs(price - known[np.clip(at, 0, len(known) - 1)]) <= 0.02 * price) if len(known) else np.zeros(len(price), bool)
    for _ in range(2):
        lo, hi = lo - near(lo - 1), hi + near(hi)
        lo, hi = lo + ((lo < hi) & ~near(lo)), hi - ((lo < hi) & ~near(hi - 1))
    return lo, np.maximum(lo, hi)


def h16_best_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The best duplicate of each part: candidates by hash bands or by price and type, scored by what agrees, over what is known."""
    bands = _best_of_bands(table(spark, d, "part"))
    prices = d13_price_band(spark, d).where("p_partkey < other")
    p = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice", F.split("p_name", " ").alias("words"))
    q = p.select(F.col("p_partkey").alias("other"), F.col("p_type").alias("t2"), F.col("p_size").alias("s2"), F.col("p_retailprice").alias("r2"), F.col("words").alias("w2"))
    both = bands.unionByName(prices).distinct().join(p, "p_partkey").join(q, "other")
    words = F.coalesce(F.size(F.array_intersect("words", "w2")) / F.greatest(F.least(F.size("words"), F.size("w2")), F.lit(1)), F.when(F.col("words").isNotNull(), 0.0))  # a candidate without name shares no word
    score = (F.when(F.col("p_type") == F.col("t2"), 3.0).otherwise(0.0) + F.when(F.col("p_size") == F.col("s2"), 2.0).otherwise(0.0) + F.when(F.abs(F.col("p_retailprice") - F.col("r2")) <= 0.02 * F.col("p_retailprice"), 1.0).otherwise(0.0) + 2.0 * words) / 8.0
    best = top_k_per(both.withColumn("score", F.round(score, 6)), ["p_partkey"], [F.desc("score"), F.asc("other")], 1)
    return best.where("score >= 0.5").select("p_partkey", "other", "score")


def i08_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Characters, words and links of every document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("chars"), T.word_count(F.col("text")).alias("words"), F.regexp_count(F.lower("text"), F.lit("http")).alias("links"))


def i19_ids_of_urls(spark: SparkSession, d: str) -> DataFrame:
    """The thing an address names: a video, an app, an issue or a post, else its last part."""
    u, part = F.col("source_url"), lambda p: F.nullif(F.regexp_extract("source_url", p, 1), F.lit(""))
    found = F.coalesce(part(r"[?&]v=([A-Za-z0-9_-]{6,})"), part(r"/app/(\d+)"), part(r"/(?:issues|comments|questions)/([A-Za-z0-9]+)"), part(r"/([^/?#]+)/?(?:[?#].*)?$"))
    return table(spark, d, "nuggets").where(u.isNotNull()).select("id", found.alias("thing"))


def i23_place_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Words that neighbouring part names share over the shorter of the two; nothing where one has none left."""
    words = F.filter(F.split(F.lower("p_name"), r"[^a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin("the", "and", "part"))
    p = table(spark, d, "part").select("p_partkey", words.alias("w"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("w").alias("w2"))
    least = F.least(F.size("w"), F.size("w2"))
    return p.join(q, "p_partkey").select("p_partkey", F.when(least > 0, F.round(F.size(F.array_intersect("w", "w2")) / least, 6)).alias("agreement"))


def i29_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the insight's first and last three words stand in the raw text in this order."""
    n = table(spark, d, "nuggets").where("extracted_insight is not null and raw_text is not null")
    words = F.split(T.squeezed(F.regexp_replace("extracted_insight", r"[^\p{L}\p{N} ]+", "")), " ")
    head, tail = F.array_join(F.slice(words, 1, 3), " "), F.array_join(F.slice(words, -3, 3), " ")
    hay = T.squeezed(F.regexp_replace("raw_text", r"[^\p{L}\p{N} ]+", ""))
    n = n.where(F.size(words) >= 6).select("id", head.alias("head"), tail.alias("tail"), hay.alias("hay"))
    at = F.instr(F.col("hay"), F.col("head"))
    after = F.instr(F.substr("hay", at + F.length("head")), F.col("tail"))
    return n.select("id", (at > 0).alias("begins"), ((at > 0) & (after > 0)).alias("verified"))


def j09_strata_of_documents(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat_ws("|", F.coalesce("lang", F.lit("unknown")), F.coalesce("text_kind", F.lit("none")), T.length_bucket(F.length(F.coalesce("text", F.lit("")))))
    return table(spark, d, "documents").groupBy(s.alias("stratum")).agg(F.count("*").alias("documents"))


def j22_bands(spark: SparkSession, d: str) -> DataFrame:
    """Match confidence in three bands, missing apart."""
    c = F.col("match_confidence")
    return table(spark, d, "signals").groupBy(F.when(c.isNull(), "missing").when(c >= 0.8, "match").when(c >= 0.78, "near").otherwise("new").alias("band")).agg(F.count("*").alias("records"))


def k07_grouped_share(spark: SparkSession, d: str) -> DataFrame:
    """Per label, vectors with a close neighbour of their own label and without."""
    from tidemark.plans.vectors import g04_nearest_with_label

    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return v.join(g04_nearest_with_label(spark, d), "id", "left").groupBy("label").agg(F.count("*").alias("vectors"), F.count("match").alias("grouped"))


def m03_thread_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every thread's comments of the archive, numbered by date, undated ones last."""
    n = table(spark, d, "nuggets").where("thread_id is not null")
    w = Window.partitionBy("platform", "thread_id").orderBy(F.asc_nulls_last(F.coalesce("created_utc", "created_at")), "id")
    return n.select("platform", "thread_id", "id", F.row_number().over(w).alias("place"))


def m07_source_verdict(spark: SparkSession, d: str) -> DataFrame:
    """What each source is worth by its visits and yield."""
    b = table(spark, d, "ingest_batch").where("source is not null").groupBy("source").agg(F.count("*").alias("visits"), F.count_if(F.json_array_length("comments").isNotNull()).alias("measured"), F.sum(F.coalesce(F.json_array_length("comments"), F.lit(0))).cast("bigint").alias("queued"))
    v = F.when(F.col("measured") == 0, "unmeasured").when(F.col("queued") == 0, F.when(F.col("visits") >= 3, "barren").otherwise("quiet")).otherwise("producing")
    return b.select("source", "visits", v.alias("verdict"))


def m17_changed_since(spark: SparkSession, d: str) -> DataFrame:
    """Archive rows newer than the last failed batch of their platform; platforms without one are not shown."""
    f = table(spark, d, "ingest_batch").where("status = 'failed'").groupBy("platform").agg(F.max("created_at").alias("since"))
    return table(spark, d, "nuggets").join(f, "platform").where("created_at > since").groupBy("platform").agg(F.count("*").alias("newer"))


def m23_filled(spark: SparkSession, d: str) -> DataFrame:
    """Archive rows completed from the incoming row of their key, field by field where they have none."""
    i = table(spark, d, "nuggets_incoming").where("unique_key is not null").groupBy("unique_key").agg(F.min_by(F.struct("author", "community", "category"), "incoming_id").alias("i"))
    n = table(spark, d, "nuggets").join(i, "unique_key")
    return n.select("id", *[F.coalesce(F.nullif(c, F.lit("")), F.col(f"i.{c}")).alias(c) for c in ("author", "community", "category")])


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_NE = "m as (select * replace (nullif(mode, '') as mode, nullif(community, '') as community, nullif(audience, '') as audience, nullif(run_id, '') as run_id, nullif(run_status, '') as run_status) from signals_mirror qualify row_number() over (partition by record_id order by last_seen_utc desc) = 1)"
_NN = "coalesce(case when json_valid(comments) then json_array_length(comments) end, 0)"
_NUM = "try_cast(replace(trim(weighted_vote_score), ',', '.') as double)"
_LEN = "case when length(coalesce(text, '')) <= 280 then 'short' when length(coalesce(text, '')) <= 1000 then 'medium' else 'long' end"
_SQ = lambda c: f"trim(regexp_replace(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}} ]+', '', 'g')), '[\\s\\p{{Z}}]+', ' ', 'g'))"
ORACLE = {
    "e23_gates": "with g as (" + " union all ".join(f"select platform, '{c}' gate, {f} flo, (coalesce({c}, '') <> '')::int h from nuggets" for c, f in FLOORS.items()) + "), s as (select platform, gate, any_value(flo) flo, count(*) n, avg(h) share from g group by platform, gate) select platform, gate, n, round(share, 6) share, case when n < 20 then 'thin' when share = 0 then 'none' when share >= flo then 'ok' else 'fail' end verdict from s",
    "e27_merged_counters": "with b as (select platform, status, count(*) n, sum(attempts) a from ingest_batch group by 1, 2) select platform, cast(sum(n) as bigint) batches, cast(sum(a) as bigint) attempts, string_agg(status || '=' || n, ',' order by status || '=' || n) by_status from b group by platform",
    "e35_alarms": f"with b as (select source, status = 'failed' bad, {_NN} n, row_number() over (partition by source order by id desc) r from ingest_batch where source is not null qualify r <= 10), s as (select source, bool_or(bad) filter (r = 1) b1, bool_or(bad) filter (r = 2) b2, bool_or(bad) filter (r = 3) b3, max(n) filter (r = 1) n1, max(n) filter (r > 1) o from b group by source) select source, 'newly_failed' alarm from s where b1 and not coalesce(b2, true) union all select source, 'repeat_failure' from s where b1 and b2 and b3 union all select source, 'shape_gone' from s where n1 = 0 and not b1 and coalesce(o, 0) > 0",
    "e47_run_counts": f"with {_NE}, g as (select run_id, count(*) collected, cast(coalesce(sum(relevant), 0) as bigint) relevant, count(*) filter (audience = 'buyer') buyer, count(*) filter (run_status <> 'ok') errors, count(edited_utc) edited from m group by run_id) select *, case when errors = 0 then 'ok' when errors < collected then 'partial' else 'error' end status from g",
    "e48_evidence_sources": "select source_url, platform, count(*) citations from nuggets where source_url is not null group by 1, 2 having count(*) > 1",
    "e51_run_flags": "with g as (select run_id, count(*) n, count(*) filter (trivial = 1) t, count(distinct platform) p, count(extracted_insight) i from nuggets group by 1) select run_id, 'all_trivial' flag from g where t = n union all select run_id, 'one_platform' from g where p = 1 and n >= 3 union all select run_id, 'no_insight' from g where i = 0",
    "f10_source_status": "with b as (select platform, cast(epoch(try_cast(created_at as timestamp)) as bigint) t from ingest_batch where platform is not null), g as (select platform, t, t - lag(t) over (partition by platform order by t) gap from b where t is not null), s as (select platform, max(t) l, max(gap) gap, count(*) n from g group by 1) select platform, n, case when gap is null then 'unknown' when (select max(t) from b) - l <= gap then 'fresh' when (select max(t) from b) - l <= 3 * gap then 'stale' else 'silent' end state from s",
    "f14_newest_graded": f"select app_id, recommendationid, {_NUM} < 0.5 alarm from mixed_vote_score where {_NUM} is not null qualify row_number() over (partition by app_id order by timestamp_updated desc, recommendationid desc, {_NUM} desc) = 1",
    "g07_rescore_queue": "select id, attempts, platform from ingest_batch where status in ('failed', 'claimed') order by attempts asc nulls first, id limit 50",
    "g02_page": f"with {_NE} select record_id, community from m order by first_seen_utc desc, record_id limit 25 offset 50",
    "i08_analysis": "select doc_id, cast(length(text) as integer) chars, cast(case when trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')), ' ')) end as integer) words, cast(len(regexp_extract_all(lower(text), 'http')) as integer) links from documents where text is not null",
    "i19_ids_of_urls": "select id, coalesce(nullif(regexp_extract(source_url, '[?&]v=([A-Za-z0-9_-]{6,})', 1), ''), nullif(regexp_extract(source_url, '/app/(\\d+)', 1), ''), nullif(regexp_extract(source_url, '/(?:issues|comments|questions)/([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(source_url, '/([^/?#]+)/?(?:[?#].*)?$', 1), '')) thing from nuggets where source_url is not null",
    "i23_place_agreement": "with p as (select p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z]+'), lambda w: length(w) > 2 and w not in ('the', 'and', 'part')) w from part) select x.p_partkey, case when least(len(x.w), len(y.w)) > 0 then round(len(list_intersect(x.w, y.w)) / least(len(x.w), len(y.w)), 6) end agreement from p x join p y on y.p_partkey = x.p_partkey + 1",
    "i29_quotes": f"with n as (select id, string_split({_SQ('extracted_insight')}, ' ') w, {_SQ('raw_text')} h from nuggets where extracted_insight is not null and raw_text is not null), q as (select id, array_to_string(w[1:3], ' ') a, array_to_string(w[len(w) - 2:len(w)], ' ') z, h from n where len(w) >= 6) select id, instr(h, a) > 0 begins, instr(h, a) > 0 and instr(substr(h, instr(h, a) + length(a)), z) > 0 verified from q",
    "j09_strata_of_documents": f"select coalesce(lang, 'unknown') || '|' || coalesce(text_kind, 'none') || '|' || {_LEN} stratum, count(*) documents from documents group by 1",
    "j22_bands": "select case when match_confidence is null then 'missing' when match_confidence >= 0.8 then 'match' when match_confidence >= 0.78 then 'near' else 'new' end band, count(*) records from signals group by 1",
    "m03_thread_detail": "select platform, thread_id, id, cast(row_number() over (partition by platform, thread_id order by coalesce(created_utc, created_at) asc nulls last, id) as integer) place from nuggets where thread_id is not null",
    "m07_source_verdict": f"with b as (select source, count(*) visits, count(case when json_valid(comments) and json_type(case when json_valid(comments) then comments end) = 'ARRAY' then 1 end) measured, sum({_NN}) queued from ingest_batch where source is not null group by 1) select source, visits, case when measured = 0 then 'unmeasured' when queued = 0 then case when visits >= 3 then 'barren' else 'quiet' end else 'producing' end verdict from b",
    "m17_changed_since": "select n.platform, count(*) newer from nuggets n join (select platform, max(created_at) since from ingest_batch where status = 'failed' group by 1) f on f.platform = n.platform where n.created_at > f.since group by 1",
    "m23_filled": "with i as (select * from nuggets_incoming where unique_key is not null qualify row_number() over (partition by unique_key order by incoming_id) = 1) select n.id, coalesce(nullif(n.author, ''), i.author) author, coalesce(nullif(n.community, ''), i.community) community, coalesce(nullif(n.category, ''), i.category) category from nuggets n join i on i.unique_key = n.unique_key",
}

from tidemark.plans import listings as _listings, vectors as _vectors  # noqa: E402  # their oracles are parts of these

ORACLE["k07_grouped_share"] = f"with g as ({_vectors.ORACLE['g04_nearest_with_label']}) select e.label, count(*) vectors, count(g.match) grouped from embeddings e left join g on g.id = e.vec_id group by e.label"
ORACLE["h16_best_duplicates"] = f"""with c as (select p_partkey, k2 other from ({_vectors.ORACLE['d12_band_join']}) union select p_partkey, other from ({_listings.ORACLE['d13_price_band']}) where p_partkey < other),
    p as (select *, string_split(p_name, ' ') w from part),
    s as (select c.p_partkey, c.other, round((case when a.p_type = b.p_type then 3 else 0 end + case when a.p_size = b.p_size then 2 else 0 end + case when abs(a.p_retailprice - b.p_retailprice) <= 0.02 * a.p_retailprice then 1 else 0 end + 2 * (len(list_intersect(a.w, b.w)) / greatest(least(len(a.w), len(b.w)), 1))) / 8, 6) score
          from c join p a on a.p_partkey = c.p_partkey join p b on b.p_partkey = c.other)
    select * from (select * from s qualify row_number() over (partition by p_partkey order by score desc, other) = 1) where score >= 0.5"""
