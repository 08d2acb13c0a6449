"""Queue of fetched batches and the comments in them: reading, pre-filters, budgets, totals, streaks, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.relational import first_wins, running_budget, streaks, top_k_per, zero_filled_days
from tidemark.session import table

COMMENT = "array<struct<id:string,body:string,score:bigint,author:string,created_at:string,depth:int,likes:bigint,edited:boolean>>"


def batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingest_batch")


def _size() -> Column:
    return F.coalesce(F.json_array_length("comments"), F.lit(0))


def comments(spark: SparkSession, d: str) -> DataFrame:
    """One row per comment of every readable batch; an unreadable array gives none."""
    items = F.from_json("comments", COMMENT)
    return batches(spark, d).where(F.json_array_length("comments") > 0).select(F.col("id").alias("batch_id"), "platform", "source", "thread_id", "run_id", F.posexplode(items).alias("pos", "c")).select(
        "batch_id", "platform", "source", "thread_id", "run_id", "pos", F.col("c.id").alias("comment_id"), F.col("c.body").alias("body"), F.col("c.score").alias("score"), F.col("c.author").alias("author"), F.col("c.depth").alias("depth"),
    )


def a02_pending_batches(spark: SparkSession, d: str) -> DataFrame:
    return batches(spark, d).where("status = 'pending' and (kind = 'comment' or kind is null)").select("id", "platform", "source", _size().cast("bigint").alias("comments"))


def a03_bounded_bite(spark: SparkSession, d: str, budget: int = 500) -> DataFrame:
    """Whole pending batches in id order until their comments reach the budget."""
    return running_budget(a02_pending_batches(spark, d), F.col("comments"), ["id"], budget).select("id", "comments")


def a04_comments(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select("batch_id", "pos", "comment_id", F.length("body").alias("chars"), "score", "depth")


def a05_posts_of_rooms(spark: SparkSession, d: str, rooms: tuple[str, ...] = ("lettinglog", "homelab")) -> DataFrame:
    """Comments of the batches whose source names one of the rooms."""
    low = F.lower("source")
    hit = F.exists(F.array(*[F.lit(r) for r in rooms]), lambda r: F.contains(low, r))
    return comments(spark, d).where(hit).select("batch_id", "source", "pos", "comment_id")


def c01_drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select("batch_id", "pos", F.coalesce(T.drop_reason(F.col("body")), F.lit("kept")).alias("reason"))


def c02_over_budget(spark: SparkSession, d: str, cap: int = 10) -> DataFrame:
    """Kept comments of each thread beyond the cap, in the order they were fetched; threadless batches count alone."""
    kept = comments(spark, d).where(T.drop_reason(F.col("body")).isNull())
    thread = F.coalesce("thread_id", F.concat(F.lit("batch "), F.col("batch_id")))
    nth = F.row_number().over(Window.partitionBy(thread).orderBy("batch_id", "pos"))
    return kept.withColumn("nth", nth).where(F.col("nth") > cap).select("batch_id", "pos", "nth")


def c03_funnel(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).groupBy(F.coalesce(T.drop_reason(F.col("body")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("comments"))


def c04_worker_funnel(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).groupBy(F.coalesce(T.worker_drop_reason(F.col("body")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("comments"))


def c05_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Automated texts among comments and documents, with the rule that fired."""
    docs = table(spark, d, "documents").select(F.lit("documents").alias("of"), F.col("doc_id").alias("id"), "text")
    bodies = comments(spark, d).select(F.lit("comments").alias("of"), F.col("batch_id").alias("id"), F.col("body").alias("text"))
    return docs.unionByName(bodies).groupBy("of", F.coalesce(T.boilerplate(F.coalesce("text", F.lit(""))), F.lit("written")).alias("rule")).agg(F.count("*").alias("texts"))


def d05_unseen_comments(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows whose fingerprint was never seen; a row without one passes."""
    seen = table(spark, d, "ingested_comments").select(F.lower(F.trim("fingerprint")).alias("f")).distinct()
    return table(spark, d, "nuggets_incoming").withColumn("f", F.lower(F.trim("fingerprint"))).join(seen, "f", "left_anti").select("incoming_id", "batch_no")


def d04_known_keys(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "nuggets").select("unique_key")
    return table(spark, d, "nuggets_incoming").join(known, "unique_key", "left_semi").select("incoming_id", "unique_key")


def d22_already_queued(spark: SparkSession, d: str) -> DataFrame:
    """Pending batches of a thread and number that another batch already holds."""
    b = batches(spark, d).where("thread_id is not null")
    done = b.where("status = 'done'").select("platform", "thread_id", "batch_index")
    return b.where("status = 'pending'").join(done, ["platform", "thread_id", "batch_index"], "left_semi").select("id", "platform", "thread_id", "batch_index")


def e32_queue_totals(spark: SparkSession, d: str) -> DataFrame:
    return batches(spark, d).groupBy("status", "kind", "platform").agg(F.count("*").alias("batches"), F.sum(_size()).cast("bigint").alias("comments"))


def e33_run_activity(spark: SparkSession, d: str) -> DataFrame:
    """Batches and failures of the last hour and day before the newest batch."""
    b = batches(spark, d).select("platform", "status", F.col("created_at").try_cast("timestamp").alias("at"))
    b = b.crossJoin(b.agg(F.max("at").alias("now")))  # one row
    hour, day = F.col("at") > F.col("now") - F.expr("interval 1 hour"), F.col("at") > F.col("now") - F.expr("interval 24 hours")
    return b.groupBy("platform").agg(F.count_if(hour).alias("last_hour"), F.count_if(day).alias("last_day"), F.count_if(day & (F.col("status") == "failed")).alias("failed_last_day"), F.max("at").cast("string").alias("newest"))


def e34_drift(spark: SparkSession, d: str, window: int = 30, spike: float = 0.25, least: int = 5) -> DataFrame:
    """Share of empty batches in each source's newest ``window`` batches against all before; both sides need ``least``."""
    b = batches(spark, d).where("source is not null and source <> ''").select("source", "id", (_size() == 0).alias("empty"))
    b = b.withColumn("newest", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("id"))) <= window)
    rate = lambda side: F.avg(F.when(side, F.col("empty").cast("double")))
    s = b.groupBy("source").agg(F.count_if("newest").alias("tail"), F.count_if(~F.col("newest")).alias("base"), rate(F.col("newest")).alias("window_rate"), rate(~F.col("newest")).alias("base_rate"))
    s = s.where((F.col("tail") >= least) & (F.col("base") >= least))
    return s.select("source", "tail", "base", F.round("window_rate", 4).alias("window_rate"), F.round("base_rate", 4).alias("base_rate"), (F.col("window_rate") - F.col("base_rate") >= spike).alias("suspect"))


def e37_source_rates(spark: SparkSession, d: str, window: int = 30) -> DataFrame:
    """Nuggets per distinct thread over each source's newest ``window`` threads."""
    threads = batches(spark, d).where("source is not null and thread_id is not null").groupBy("source", "platform", "thread_id").agg(F.max("id").alias("newest"))
    recent = top_k_per(threads, ["source"], [F.desc("newest")], window)
    yielded = table(spark, d, "nuggets").where("thread_id is not null").groupBy("platform", "thread_id").agg(F.count("*").alias("nuggets"))
    scored = recent.join(yielded, ["platform", "thread_id"], "left").groupBy("source").agg(F.count("*").alias("threads"), F.sum(F.coalesce("nuggets", F.lit(0))).alias("nuggets"))
    return scored.withColumn("rate", F.round(F.col("nuggets") / F.col("threads"), 6))


def e38_rate_watermark(spark: SparkSession, d: str) -> DataFrame:
    """The true median of the rates above zero; one rate alone stands for itself."""
    return e37_source_rates(spark, d).where("rate > 0").agg(F.round(F.median("rate"), 6).alias("watermark"), F.count("*").alias("sources"))


def f06_failure_streaks(spark: SparkSession, d: str) -> DataFrame:
    """How many of each source's newest batches failed in a row."""
    b = batches(spark, d).where("source is not null")
    return streaks(b, ["source"], [F.desc("id")], F.col("status") == "failed").withColumn("repeat_failure", F.col("streak") >= 3)


def f07_source_state(spark: SparkSession, d: str) -> DataFrame:
    """Each source's quiet and error streaks and its last batch with comments, over batches by day."""
    run = batches(spark, d).where("source is not null").groupBy("source", F.substring("created_at", 1, 10).alias("day")).agg(F.sum(_size()).alias("rows"), F.count_if(F.col("status") == "failed").alias("errors"))
    newest = Window.partitionBy("source").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    error, quiet = F.col("errors") > 0, (F.col("errors") == 0) & (F.col("rows") == 0)
    run = run.withColumn("broken_e", F.sum((~error).cast("int")).over(newest)).withColumn("broken_q", F.sum((~quiet).cast("int")).over(newest))
    ok = F.max(F.when((F.col("errors") == 0) & (F.col("rows") > 0), F.col("day")))
    return run.groupBy("source").agg(F.count_if(F.col("broken_e") == 0).alias("consecutive_error"), F.count_if(F.col("broken_q") == 0).alias("consecutive_zero"), ok.alias("last_ok"), F.max_by("rows", "day").alias("last_rows"))


def f09_observed_interval(spark: SparkSession, d: str, gaps: int = 12) -> DataFrame:
    """The longest of each source's newest ``gaps`` positive gaps between batches, in hours."""
    b = batches(spark, d).where("source is not null").select("source", F.unix_seconds(F.col("created_at").try_cast("timestamp")).alias("at")).where("at is not null")
    w = Window.partitionBy("source").orderBy("at")
    g = b.withColumn("gap", F.col("at") - F.lag("at").over(w)).where("gap > 0")
    return top_k_per(g, ["source"], [F.desc("at")], gaps).groupBy("source").agg(F.round(F.max("gap") / 3600, 4).alias("gap_hours"), F.count("*").alias("gaps"))


def f13_trend(spark: SparkSession, d: str) -> DataFrame:
    """The newest batch of each source and the length of its series."""
    b = batches(spark, d).where("source is not null")
    return b.groupBy("source").agg(F.max_by("status", "id").alias("last_status"), F.max("id").alias("last_id"), F.count("*").alias("series"))


def g05_rotation(spark: SparkSession, d: str) -> DataFrame:
    """Document sources in the order to visit: never fetched first, then the one fetched longest ago."""
    sources = table(spark, d, "documents").select("source").distinct()
    last = batches(spark, d).groupBy("source").agg(F.max("created_at").alias("last"))
    return sources.join(last, "source", "left").select("source", "last", F.row_number().over(Window.orderBy(F.asc_nulls_first("last"), "source")).alias("turn"))  # one row per source


def h01_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Every comment whose text another one had first, with the row that was kept; blank texts are kept."""
    c = comments(spark, d).withColumn("rid", F.concat_ws("#", "batch_id", "pos"))
    key = T.squeezed(F.coalesce("body", F.lit("")))
    out = first_wins(c.select("rid", "batch_id", "pos", "body"), key, [F.col("batch_id"), F.col("pos")], "rid")
    return out.where("kept_id <> rid").select("rid", "kept_id")


def h08_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    """Id, else the hash of the body; in a run the first row of an id wins."""
    c = comments(spark, d).withColumn("stable_id", F.coalesce(F.nullif("comment_id", F.lit("")), T.short_hash(F.coalesce("body", F.lit("")))))
    return top_k_per(c, ["run_id", "stable_id"], [F.asc("batch_id"), F.asc("pos")], 1).select("run_id", "stable_id", "batch_id", "pos")


def i07_text_counts(spark: SparkSession, d: str) -> DataFrame:
    return comments(spark, d).select("batch_id", "pos", T.emoji_count(F.col("body")).alias("emoji"), T.mention_count(F.col("body")).alias("mentions"), T.word_count(F.col("body")).alias("words"))


def l12_daily_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches and comments per day, days without any as zero."""
    day = batches(spark, d).groupBy(F.to_date(F.col("created_at").try_cast("timestamp")).alias("day")).agg(F.count("*").alias("batches"), F.sum(_size()).cast("bigint").alias("comments")).where("day is not null")
    return zero_filled_days(day, "day", ["batches", "comments"])


def m13_platform_counts(spark: SparkSession, d: str) -> DataFrame:
    return batches(spark, d).groupBy("run_id", "platform").agg(F.count("*").alias("batches"), F.bool_and(F.col("status") == "done").alias("all_done"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_B = "b as (select *, coalesce(case when json_valid(comments) then json_array_length(comments) end, 0) n from ingest_batch)"
_C = "c as (select id batch_id, platform, source, thread_id, run_id, unnest(range(cast(n as bigint))) pos, comments from (select *, case when json_valid(comments) then json_array_length(comments) end n from ingest_batch) where n > 0), k as (select *, json_extract_string(comments, '$[' || pos || '].body') body, json_extract_string(comments, '$[' || pos || '].id') comment_id from c)"
_EM = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}\x{2B50}]"
_WORDS = lambda x: f"case when trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')), ' ')) end"
_NORM = "regexp_replace(lower(trim(body)), '^[!.?…]+|[!.?…]+$', '', 'g')"
_R = "'+1','this','same','lol','lmao','haha','true','facts','agreed','^'"
_REASON = f"case when trim(coalesce(body, '')) = '' then 'too_short' when {_NORM} in ({_R}) then 'reaction_only' when length(trim(body)) < 40 then 'too_short' when length(trim(body)) > 600 then 'too_long' when len(regexp_extract_all(body, '{_EM}')) > 5 then 'emoji_spam' when len(regexp_extract_all(body, '@\\w+')) > 3 then 'mention_spam' when {_WORDS(_NORM)} < 6 then 'too_few_words' else 'kept' end"
_quote = lambda s: s.replace("'", "''")
_BOT = "case when " + " or ".join(f"contains(lower(trim(x)), '{_quote(p)}')" for p in T.BOT_PHRASES) + " then 'bot_phrase' when " + " or ".join(f"regexp_matches(x, '{_quote(p)}')" for p in T.BOT_PATTERNS) + " then 'bot_pattern' end"
_WIDE = r"[\x{10000}-\x{10FFFF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}]"

ORACLE = {
    "a02_pending_batches": f"with {_B} select id, platform, source, cast(n as bigint) comments from b where status = 'pending' and (kind = 'comment' or kind is null)",
    "a03_bounded_bite": f"with {_B}, p as (select id, cast(n as bigint) comments, coalesce(sum(n) over (order by id rows between unbounded preceding and 1 preceding), 0) before from b where status = 'pending' and (kind = 'comment' or kind is null)) select id, comments from p where before < 500",
    "a04_comments": f"with {_C} select batch_id, cast(pos as integer) pos, comment_id, length(body) chars, cast(json_extract_string(comments, '$[' || pos || '].score') as bigint) score, cast(json_extract_string(comments, '$[' || pos || '].depth') as integer) depth from k",
    "a05_posts_of_rooms": f"with {_C} select batch_id, source, cast(pos as integer) pos, comment_id from k where contains(lower(source), 'lettinglog') or contains(lower(source), 'homelab')",
    "c01_drop_reasons": f"with {_C} select batch_id, cast(pos as integer) pos, {_REASON} reason from k",
    "c02_over_budget": f"with {_C}, r as (select *, row_number() over (partition by coalesce(thread_id, 'batch ' || batch_id) order by batch_id, pos) nth from k where {_REASON} = 'kept') select batch_id, cast(pos as integer) pos, nth from r where nth > 10",
    "c03_funnel": f"with {_C} select {_REASON} reason, count(*) comments from k group by 1",
    "c04_worker_funnel": f"with {_C}, w as (select coalesce(body, '') x from k) select case when length(x) < 40 then 'too_short' when length(x) > 600 then 'too_long' when {_WORDS('x')} < 6 then 'too_few_words' when len(regexp_extract_all(x, '{_WIDE}')) > 5 then 'emoji_spam' when len(regexp_extract_all(x, '@')) > 3 then 'mention_spam' when not regexp_matches(x, '\\p{{L}}') then 'no_letters' else coalesce({_BOT}, 'kept') end reason, count(*) comments from w group by 1",
    "c05_boilerplate": f"with {_C}, t as (select 'documents' as of, coalesce(text, '') x from documents union all select 'comments', coalesce(body, '') from k) select of, coalesce({_BOT}, 'written') rule, count(*) texts from t group by 1, 2",
    "d05_unseen_comments": "select incoming_id, batch_no from nuggets_incoming i where not exists (select 1 from ingested_comments c where lower(trim(c.fingerprint)) = lower(trim(i.fingerprint)))",
    "d04_known_keys": "select incoming_id, unique_key from nuggets_incoming where unique_key in (select unique_key from nuggets where unique_key is not null)",
    "d22_already_queued": "select id, platform, thread_id, batch_index from ingest_batch p where status = 'pending' and exists (select 1 from ingest_batch b where b.status = 'done' and b.platform = p.platform and b.thread_id = p.thread_id and b.batch_index = p.batch_index)",
    "e32_queue_totals": f"with {_B} select status, kind, platform, count(*) batches, cast(sum(n) as bigint) comments from b group by all",
    "e33_run_activity": "with b as (select platform, status, try_cast(created_at as timestamp) t from ingest_batch), n as (select max(t) now from b) select platform, count(*) filter (t > now - interval 1 hour) last_hour, count(*) filter (t > now - interval 24 hour) last_day, count(*) filter (t > now - interval 24 hour and status = 'failed') failed_last_day, strftime(max(t), '%Y-%m-%d %H:%M:%S') newest from b, n group by platform",
    "e34_drift": f"with {_B}, r as (select source, (n = 0)::double e, row_number() over (partition by source order by id desc) <= 30 t from b where source is not null and source <> ''), s as (select source, count(*) filter (t) tail, count(*) filter (not t) base, avg(e) filter (t) w, avg(e) filter (not t) o from r group by source) select source, tail, base, round(w, 4) window_rate, round(o, 4) base_rate, w - o >= 0.25 suspect from s where tail >= 5 and base >= 5",
    "e37_source_rates": "with t as (select source, platform, thread_id, max(id) m from ingest_batch where source is not null and thread_id is not null group by all), r as (select * from t qualify row_number() over (partition by source order by m desc) <= 30), y as (select platform, thread_id, count(*) n from nuggets where thread_id is not null group by all) select source, count(*) threads, cast(sum(coalesce(n, 0)) as bigint) nuggets, round(sum(coalesce(n, 0)) / count(*), 6) rate from r left join y using (platform, thread_id) group by source",
    "f06_failure_streaks": "with r as (select source, row_number() over (partition by source order by id desc) rn, status = 'failed' f from ingest_batch where source is not null), s as (select source, count(*) n, min(rn) filter (not f) fi from r group by source) select source, coalesce(fi - 1, n) streak, coalesce(fi - 1, n) >= 3 repeat_failure from s",
    "f07_source_state": f"with {_B}, r as (select source, substr(created_at, 1, 10) as day, cast(sum(n) as bigint) as rows, count(*) filter (status = 'failed') errors from b where source is not null group by all), o as (select *, row_number() over (partition by source order by day desc) rn from r) select source, coalesce(min(rn) filter (errors = 0) - 1, count(*)) consecutive_error, coalesce(min(rn) filter (errors > 0 or rows > 0) - 1, count(*)) consecutive_zero, max(day) filter (errors = 0 and rows > 0) last_ok, arg_max(rows, day) last_rows from o group by source",
    "f09_observed_interval": "with b as (select source, cast(epoch(try_cast(created_at as timestamp)) as bigint) t from ingest_batch where source is not null), g as (select source, t, t - lag(t) over (partition by source order by t) gap from b), k as (select * from g where gap > 0 qualify row_number() over (partition by source order by t desc) <= 12) select source, round(max(gap) / 3600, 4) gap_hours, count(*) gaps from k group by source",
    "f13_trend": "select source, arg_max(status, id) last_status, max(id) last_id, count(*) series from ingest_batch where source is not null group by source",
    "g05_rotation": "with l as (select source, max(created_at) last from ingest_batch group by source) select d.source, l.last, cast(row_number() over (order by l.last asc nulls first, d.source) as integer) turn from (select distinct source from documents) d left join l on d.source = l.source",
    "h01_first_wins": f"with {_C}, n as (select batch_id || '#' || pos rid, batch_id, pos, trim(regexp_replace(lower(coalesce(body, '')), '[\\s\\p{{Z}}]+', ' ', 'g')) x from k), f as (select *, first_value(rid) over (partition by x order by batch_id, pos) kept_id from n where x <> '') select rid, kept_id from f where rid <> kept_id",
    "h08_stable_ids": f"with {_C}, s as (select run_id, coalesce(nullif(comment_id, ''), substr(sha1(coalesce(body, '')), 1, 16)) stable_id, batch_id, cast(pos as integer) pos from k) select * from s qualify row_number() over (partition by run_id, stable_id order by batch_id, pos) = 1",
    "i07_text_counts": f"with {_C} select batch_id, cast(pos as integer) pos, cast(len(regexp_extract_all(body, '{_EM}')) as integer) emoji, cast(len(regexp_extract_all(body, '@\\w+')) as integer) mentions, cast({_WORDS('body')} as integer) words from k",
    "l12_daily_batches": f"with {_B}, c as (select cast(try_cast(created_at as timestamp) as date) as day, count(*) batches, sum(n) comments from b where try_cast(created_at as timestamp) is not null group by 1), s as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from c) select s.day, coalesce(batches, 0) batches, cast(coalesce(comments, 0) as bigint) comments from s left join c using (day)",
    "m13_platform_counts": "select run_id, platform, count(*) batches, bool_and(status = 'done') all_done from ingest_batch group by all",
}
ORACLE["e38_rate_watermark"] = f"with s as ({ORACLE['e37_source_rates']}) select round(median(rate), 6) watermark, count(*) sources from s where rate > 0"
