"""Captured payloads to flat rows, JSON paths and trees, times in several layouts, integrity checks, optimistic edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.relational import top_k_per
from tidemark.plans.queue import comments
from tidemark.session import table


def a01_checked_tables(spark: SparkSession, d: str) -> DataFrame:
    """Columns every reader relies on, with whether the table has them in the type asked for."""
    wanted = {"nuggets": {"id": "bigint", "unique_key": "string", "trivial": "int"}, "ingest_batch": {"id": "bigint", "comments": "string"}, "signals": {"record_id": "string", "match_confidence": "double"}, "documents": {"doc_id": "bigint", "text": "string"}}
    rows = [(t, c, k, dict(table(spark, d, t).dtypes).get(c) == k) for t, cs in wanted.items() for c, k in cs.items()]
    return spark.createDataFrame(rows, "table_name string, column_name string, type string, present boolean")


def a20_flat_tree(spark: SparkSession, d: str) -> DataFrame:
    """Comments of a batch as a tree by their depth: the parent is the last one before with a smaller depth by one."""
    c = comments(spark, d).select("batch_id", "pos", F.coalesce("depth", F.lit(0)).alias("depth"))
    w = Window.partitionBy("batch_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    most = 8  # depths are small; one running maximum each
    for k in range(most):
        c = c.withColumn(f"last_{k}", F.max(F.when(F.col("depth") == k, F.col("pos"))).over(w))
    parent = F.lit(None).cast("int")
    for k in range(most):
        parent = F.when(F.col("depth") == k + 1, F.col(f"last_{k}")).otherwise(parent)
    return c.select("batch_id", "pos", "depth", parent.alias("parent_pos"))


def a21_depth_of_path(spark: SparkSession, d: str) -> DataFrame:
    """Depth and parent read from a dotted path, here the parts of each nugget's key."""
    parts = F.split("unique_key", ":")
    return table(spark, d, "nuggets").where("unique_key is not null").select("id", (F.size(parts) - 1).alias("depth"), F.try_element_at(parts, F.lit(-2)).alias("parent"))


def i12_json_paths(spark: SparkSession, d: str) -> DataFrame:
    """Values of a path through every object of the comment arrays: how many are there, numbers and texts apart."""
    body = F.from_json("comments", "array<map<string,string>>")
    each = table(spark, d, "ingest_batch").where("json_array_length(comments) > 0").select("platform", F.explode(body).alias("m")).select("platform", F.explode("m").alias("path", "value"))
    return each.groupBy("platform", "path").agg(F.count("*").alias("objects"), F.count("value").alias("values"))


def j19_coerced_payloads(spark: SparkSession, d: str) -> DataFrame:
    """A thread's own numbers from its metadata under any of their names; unreadable and empty ones are null."""
    first = lambda *names: F.coalesce(*[F.nullif(F.get_json_object("thread_meta", f"$.{n}"), F.lit("")).try_cast("double") for n in names])
    return table(spark, d, "ingest_batch").select("id", first("score", "ups", "upvotes").alias("score"), first("num_comments", "comments", "replies", "comment_count").alias("advertised"))


def j02_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Times in several layouts as seconds, empty where none fits; epoch 0 is no time."""
    epoch = F.nullif(F.unix_seconds(F.timestamp_seconds("timestamp_updated")), F.lit(0))
    r = table(spark, d, "mixed_vote_score").select("recommendationid", epoch.alias("s"), F.date_format(F.timestamp_seconds("timestamp_updated"), "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(F.timestamp_seconds("timestamp_updated"), "dd/MM/yyyy HH:mm").alias("b"))
    read = lambda c: F.coalesce(*[F.unix_seconds(F.try_to_timestamp(c, F.lit(f))) for f in ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd")])
    return r.agg(F.count("*").alias("rows"), F.count_if(read(F.col("a")) == F.col("s")).alias("exact"), F.count_if(read(F.col("b")) == F.expr("s div 60 * 60")).alias("to_the_minute"))


def j18_batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_batch").select("id", F.coalesce(F.json_array_length("comments"), F.lit(0)).alias("comments"), F.coalesce(F.json_array_length("listings"), F.lit(0)).alias("listings"))


def n01_absent_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Per platform, comments whose likes are absent, zero, or more: an absent number is not 0."""
    c = table(spark, d, "ingest_batch").where("json_array_length(comments) > 0").select("platform", F.explode(F.from_json("comments", "array<struct<likes:bigint>>")).alias("c"))
    return c.groupBy("platform").agg(F.count_if(F.col("c.likes").isNull()).alias("absent"), F.count_if(F.col("c.likes") == 0).alias("zero"), F.count_if(F.col("c.likes") > 0).alias("more"))


def n05_review_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Positive less negative reviews and the share of positive ones per app, over the newest version of each review."""
    r = top_k_per(table(spark, d, "mixed_vote_score").where("voted_up is not null"), ["recommendationid"], [F.desc("timestamp_updated"), F.desc("voted_up")], 1)
    up = F.count_if("voted_up")
    return r.groupBy("app_id").agg((2 * up - F.count("*")).alias("score"), F.round(F.try_divide(up, F.count("*")), 6).alias("ratio"))


def n11_listed_posts(spark: SparkSession, d: str, least: int = 3) -> DataFrame:
    """Threads of the queue once each, with enough comments over all their batches."""
    b = table(spark, d, "ingest_batch").where("thread_id is not null and status <> 'failed'")
    return b.groupBy("platform", "thread_id").agg(F.sum(F.coalesce(F.json_array_length("comments"), F.lit(0))).cast("bigint").alias("comments"), F.min("id").alias("first_batch")).where(F.col("comments") >= least)


def n12_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first tag of an ordered list that their source's name holds."""
    tags = F.split(F.regexp_replace(F.coalesce("source", F.lit("")), "[^a-z]+", " "), " ")
    first = F.lit("other")
    for t in ("pod", "portal", "forum", "boards", "app"):  # the last one set is asked first
        first = F.when(F.array_contains(tags, t), t).otherwise(first)
    return table(spark, d, "documents").groupBy(first.alias("bucket")).agg(F.count("*").alias("documents"))


def n17_engagement(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of work a text names, sorted and once each, or unknown."""
    hits = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)\b(remote|contract|freelance|full-time|part-time|onsite|hybrid)\b"), F.lit(1)), lambda x: F.lower(x))))
    label = F.coalesce(F.nullif(F.array_join(hits, ","), F.lit("")), F.lit("unknown"))
    return table(spark, d, "documents").where("text is not null").groupBy(label.alias("engagement")).agg(F.count("*").alias("documents"))


def n18_headlines(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty parts joined by a bar, at most 150 characters."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("community", "author", "title")]
    return table(spark, d, "signals").select("record_id", F.substring(F.concat_ws(" | ", *parts), 1, 150).alias("headline"))


def n19_complete_reads(spark: SparkSession, d: str) -> DataFrame:
    """Per run and source: distinct threads read and whether every batch was done."""
    return table(spark, d, "ingest_batch").where("source is not null").groupBy("run_id", "source").agg(F.count_distinct("thread_id").alias("threads"), F.bool_and(F.col("status") == "done").alias("complete"))


def h14_edits(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows as edits of the archive row of their key: applied only where the category they saw still stands."""
    n = table(spark, d, "nuggets").where("unique_key is not null").groupBy("unique_key").agg(F.min(F.struct("id", "category")).alias("n"))
    e = table(spark, d, "nuggets_incoming").select("incoming_id", "unique_key", F.col("category").alias("seen")).join(n, "unique_key")
    verdict = F.when(F.col("seen").eqNullSafe(F.col("n.category")), "applied").otherwise("refused")
    return e.select("incoming_id", F.col("n.id").alias("nugget_id"), verdict.alias("verdict"))


def h13_quota(spark: SparkSession, d: str, daily: int = 20) -> DataFrame:
    """Comments each platform may spend per day: batches in order are granted while the sum before them is under the quota."""
    b = table(spark, d, "ingest_batch").select("platform", F.substring("created_at", 1, 10).alias("day"), "id", F.coalesce(F.json_array_length("comments"), F.lit(0)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("platform", "day").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("granted", before < daily).groupBy("platform").agg(F.count_if("granted").alias("granted"), F.count_if(~F.col("granted")).alias("held"))


def m09_doctor(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the archive's health, one row per check."""
    b, n, i = table(spark, d, "ingest_batch"), table(spark, d, "nuggets"), table(spark, d, "nuggets_incoming")
    counts = [("failed_batches", b.where("status = 'failed'")), ("stuck_batches", b.where("status = 'claimed'")), ("backlog", b.where("status = 'pending'")), ("unreadable", b.where("comments is not null and json_array_length(comments) is null")),
              ("unembedded", n.where("embedding_model is null")), ("orphans", i.where("unique_key is not null").join(n.select("unique_key"), "unique_key", "left_anti"))]
    out = None
    for name, df in counts:
        one = df.agg(F.lit(name).alias("finding"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out


def m15_latest_checks(spark: SparkSession, d: str) -> DataFrame:
    """The newest event of each user and type, with whether its value was positive."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), (F.max_by("value", "event_id") > 0).alias("ok"))


def m19_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Events per user's day long to wide, one column per type."""
    types = ["click", "view", "purchase", "signup", "scroll"]
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"))
    return e.agg(*[F.count_if(F.col("event_type") == t).alias(f"n_{t}") for t in types], F.count_if(~F.col("event_type").isin(types)).alias("n_other"))


def m11_longest_silence(spark: SparkSession, d: str) -> DataFrame:
    """The longest gap between batches of each platform, in whole minutes."""
    w = Window.partitionBy("platform").orderBy("at")
    b = table(spark, d, "ingest_batch").select("platform", F.unix_seconds(F.col("created_at").try_cast("timestamp")).alias("at")).where("at is not null")
    return b.withColumn("gap", F.col("at") - F.lag("at").over(w)).groupBy("platform").agg(F.max(F.expr("gap div 60")).alias("silent_minutes"))


def m16_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Per address, its newest archive row and the hash of its text."""
    n = table(spark, d, "nuggets").where("source_url is not null").groupBy("source_url").agg(F.max_by(F.struct("id", F.sha2("raw_text", 256).alias("h")), "id").alias("x"))
    return n.select("source_url", F.col("x.id").alias("id"), F.col("x.h").alias("text_sha256"))


def m25_platforms_of_urls(spark: SparkSession, d: str) -> DataFrame:
    h = T.host(F.col("source_url"))
    rules: list[tuple[str, Column]] = [("reddit", h.endswith("reddit.com")), ("hackernews", h == "news.ycombinator.com"), ("github", h == "github.com"), ("stackexchange", h.endswith("stackexchange.com")), ("youtube", h.endswith("youtube.com")), ("steam", h.endswith("steampowered.com"))]
    kind = F.lit("web")
    for name, hit in rules[::-1]:
        kind = F.when(hit, name).otherwise(kind)
    return table(spark, d, "nuggets").where("source_url is not null").groupBy("platform", kind.alias("url_platform")).agg(F.count("*").alias("rows"))


def d06_stale_unanswered(spark: SparkSession, d: str, days: int = 60) -> DataFrame:
    """Nuggets older than ``days`` days before the newest whose thread is in no batch of the queue."""
    n = table(spark, d, "nuggets").withColumn("at", F.col("created_at").try_cast("timestamp"))
    old = n.crossJoin(n.agg(F.max("at").alias("newest"))).where(F.col("at") < F.col("newest") - F.expr(f"interval {int(days)} days"))  # one row
    return old.join(table(spark, d, "ingest_batch").select("thread_id"), "thread_id", "left_anti").select("id", "thread_id")


def d09_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Links of signals to runs and texts that do not hold, by kind."""
    s = table(spark, d, "signals")
    bad = F.array_compact(F.array(F.when(F.coalesce("text_hash", F.lit("")) == "", "no_text_hash"), F.when(F.coalesce("run_id", F.lit("")) == "", "no_run"), F.when(F.col("record_id") != F.concat_ws(":", "platform", "source_id"), "key_mismatch")))
    return s.select(F.explode(bad).alias("failure")).groupBy("failure").agg(F.count("*").alias("records"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_HOST = "nullif(regexp_replace(lower(regexp_extract(source_url, '^(?i:https?)://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', ''), '')"
_N = "coalesce(case when json_valid(comments) then json_array_length(comments) end, 0)"
_K = f"k as (select platform, id batch_id, comments, unnest(range(cast(n as bigint))) i from (select *, {_N} n from ingest_batch) where n > 0)"
_J = lambda p: f"try_cast(nullif(json_extract_string(case when json_valid(thread_meta) then thread_meta end, '$.{p}'), '') as double)"
_TY = ["click", "view", "purchase", "signup", "scroll"]
ORACLE = {
    "a20_flat_tree": f"with {_K}, c as (select batch_id, cast(i as integer) pos, coalesce(cast(json_extract_string(comments, '$[' || i || '].depth') as integer), 0) depth from k) select batch_id, pos, depth, (select max(x.pos) from c x where x.batch_id = c.batch_id and x.pos < c.pos and x.depth = c.depth - 1) parent_pos from c",
    "a21_depth_of_path": "select id, cast(len(string_split(unique_key, ':')) - 1 as integer) depth, string_split(unique_key, ':')[-2] parent from nuggets where unique_key is not null",
    "i12_json_paths": f"with {_K}, o as (select platform, json_extract(comments, '$[' || i || ']') o from k), e as (select platform, o, unnest(json_keys(o)) path from o) select platform, path, count(*) objects, count(json_extract_string(o, '$.' || path)) as values from e group by all".replace("group by all", "group by platform, path"),
    "j19_coerced_payloads": f"select id, coalesce({_J('score')}, {_J('ups')}, {_J('upvotes')}) score, coalesce({_J('num_comments')}, {_J('comments')}, {_J('replies')}, {_J('comment_count')}) advertised from ingest_batch",
    "j02_layouts": "select count(*) as rows, count(*) exact, count(*) to_the_minute from mixed_vote_score",
    "j18_batch_sizes": f"select id, cast({_N} as integer) as comments, cast(coalesce(case when json_valid(listings) then json_array_length(listings) end, 0) as integer) listings from ingest_batch",
    "n01_absent_numbers": f"with {_K}, l as (select platform, cast(json_extract_string(comments, '$[' || i || '].likes') as bigint) v from k) select platform, count(*) filter (v is null) absent, count(*) filter (v = 0) zero, count(*) filter (v > 0) as more from l group by platform",
    "n05_review_ratios": "with r as (select * from mixed_vote_score where voted_up is not null qualify row_number() over (partition by recommendationid order by timestamp_updated desc, voted_up desc) = 1) select app_id, 2 * count(*) filter (voted_up) - count(*) score, round(count(*) filter (voted_up) / count(*), 6) ratio from r group by app_id",
    "n11_listed_posts": f"select platform, thread_id, cast(sum({_N}) as bigint) as comments, min(id) first_batch from ingest_batch where thread_id is not null and status <> 'failed' group by 1, 2 having sum({_N}) >= 3",
    "n12_buckets": "select case " + " ".join(f"when regexp_matches(' ' || regexp_replace(coalesce(source, ''), '[^a-z]+', ' ', 'g') || ' ', ' {t} ') then '{t}'" for t in ("app", "boards", "forum", "portal", "pod")) + " else 'other' end bucket, count(*) documents from documents group by 1",
    "n17_engagement": "select coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\b(remote|contract|freelance|full-time|part-time|onsite|hybrid)\\b', 1), lambda z: lower(z)))), ','), ''), 'unknown') engagement, count(*) documents from documents where text is not null group by 1",
    "n18_headlines": "select record_id, substr(concat_ws(' | ', nullif(trim(community), ''), nullif(trim(author), ''), nullif(trim(title), '')), 1, 150) headline from signals",
    "n19_complete_reads": "select run_id, source, count(distinct thread_id) threads, bool_and(status = 'done') complete from ingest_batch where source is not null group by 1, 2",
    "h14_edits": "with n as (select unique_key, id, category from nuggets where unique_key is not null qualify row_number() over (partition by unique_key order by id) = 1) select incoming_id, n.id nugget_id, case when i.category is not distinct from n.category then 'applied' else 'refused' end verdict from nuggets_incoming i join n on n.unique_key = i.unique_key",
    "h13_quota": f"with b as (select platform, coalesce(sum({_N}) over (partition by platform, substr(created_at, 1, 10) order by id rows between unbounded preceding and 1 preceding), 0) p from ingest_batch) select platform, count(*) filter (p < 20) granted, count(*) filter (p >= 20) held from b group by platform",
    "m09_doctor": "select 'failed_batches' finding, count(*) as rows from ingest_batch where status = 'failed' union all select 'stuck_batches', count(*) from ingest_batch where status = 'claimed' union all select 'backlog', count(*) from ingest_batch where status = 'pending' union all select 'unreadable', count(*) from ingest_batch where comments is not null and not coalesce(case when json_valid(comments) then json_type(comments) = 'ARRAY' end, false) union all select 'unembedded', count(*) from nuggets where embedding_model is null union all select 'orphans', count(*) from nuggets_incoming i where unique_key is not null and not exists (select 1 from nuggets n where n.unique_key = i.unique_key)",
    "m15_latest_checks": "select user_id, event_type, max(event_id) event_id, arg_max(value, event_id) > 0 ok from events group by 1, 2",
    "m19_pivot": "select cast(ts as date) as day, " + ", ".join(f"count(*) filter (event_type = '{t}') n_{t}" for t in _TY) + ", count(*) filter (event_type not in (" + ", ".join(f"'{t}'" for t in _TY) + ")) n_other from events group by 1",
    "m11_longest_silence": "with b as (select platform, cast(epoch(try_cast(created_at as timestamp)) as bigint) t from ingest_batch), g as (select platform, (t - lag(t) over (partition by platform order by t)) // 60 gap from b where t is not null) select platform, max(gap) silent_minutes from g group by platform",
    "m16_manifest": "select source_url, max(id) id, arg_max(sha256(raw_text), id) text_sha256 from (select source_url, id, raw_text from nuggets where source_url is not null) group by 1",
    "m25_platforms_of_urls": f"select platform, case when {_HOST} like '%reddit.com' then 'reddit' when {_HOST} = 'news.ycombinator.com' then 'hackernews' when {_HOST} = 'github.com' then 'github' when {_HOST} like '%stackexchange.com' then 'stackexchange' when {_HOST} like '%youtube.com' then 'youtube' when {_HOST} like '%steampowered.com' then 'steam' else 'web' end url_platform, count(*) as rows from nuggets where source_url is not null group by 1, 2",
    "d06_stale_unanswered": "with n as (select id, thread_id, try_cast(created_at as timestamp) t from nuggets) select id, thread_id from n where t < (select max(t) from n) - interval 60 day and not exists (select 1 from ingest_batch b where b.thread_id = n.thread_id)",
    "d09_linkage": "with f as (select unnest([case when coalesce(text_hash, '') = '' then 'no_text_hash' end, case when coalesce(run_id, '') = '' then 'no_run' end, case when record_id <> concat_ws(':', platform, source_id) then 'key_mismatch' end]) failure from signals) select failure, count(*) records from f where failure is not null group by failure",
}
