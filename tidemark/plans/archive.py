"""Accepted archive, reviews and documents: reading, flags, strata and samples, hashes, retention, communities, labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.chunks import chunk_text
from tidemark.operators.relational import latest_by, top_k_per
from tidemark.operators.sampling import proportional_sizes
from tidemark.session import table

SEED = 20260801
#: Words too common to describe anything. Fixed values.
STOP = """a an the and or but if then than that this these those there here it its it's is are was were be been being am do does did doing have has had having i you he she they we me him her
them us my your his their our mine yours to of in on at by for with from into over under about as not no nor so such can could will would shall should may might must just also very really quite what which who
whom whose when where why how all any both each few more most other some only own same too s t don now get got make made use used using one two like know think want need thing things way ways lot lots time""".split()


def nuggets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nuggets")


def a06_newest_nuggets(spark: SparkSession, d: str, limit: int = 100) -> DataFrame:
    """The newest rows of the archive; the limit is applied before anything is sorted in full."""
    return nuggets(spark, d).select("id", "unique_key", "category", "platform", "created_at").orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)


def c06_trivial(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).select("id", F.array_join(T.trivial_reasons(F.col("raw_text")), ",").alias("reasons"))


def c14_archive_page(spark: SparkSession, d: str, term: str = "spreadsheet", limit: int = 50, offset: int = 10) -> DataFrame:
    """One page of the rows with the term in any of three text columns, in any letter case."""
    hit = F.lit(False)
    for c in ("raw_text", "extracted_insight", "author"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term))
    return nuggets(spark, d).where(hit).select("id", "platform", "category").orderBy(F.desc("id")).offset(offset).limit(limit)


def c16_flags(spark: SparkSession, d: str) -> DataFrame:
    n = nuggets(spark, d)
    flags = {"trivial": F.col("trivial") == 1, "reembed": F.col("embedding_model").isNull(), "stand_in": F.col("embedding_model") == "fake (hash)", "no_author": F.col("author").isNull(), "no_insight": F.col("extracted_insight").isNull(), "no_thread": F.col("thread_id").isNull()}
    return n.groupBy("platform").agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def c17_search(spark: SparkSession, d: str, term: str = "($") -> DataFrame:
    """Rows that hold the term itself; wildcards in it mean nothing."""
    return nuggets(spark, d).where(F.contains(F.lower("raw_text"), F.lit(term.lower()))).select("id")


def e28_thread_stats(spark: SparkSession, d: str) -> DataFrame:
    g = nuggets(spark, d).where("thread_id is not null").groupBy("thread_id").agg(
        F.count("*").alias("members"), F.count_distinct(F.lower("author")).alias("authors"), F.count_if(F.col("author").isNull()).alias("unknown_authors"),
        F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"),
    )
    return g.withColumn("single_author", (F.col("authors") == 1) & (F.col("unknown_authors") == 0))


def e29_posts(spark: SparkSession, d: str) -> DataFrame:
    """Each thread with its newest date, rows, rows without insight and most upvotes."""
    return nuggets(spark, d).groupBy("platform", "thread_id").agg(
        F.max(F.coalesce("created_utc", "created_at")).alias("newest"), F.count("*").alias("rows"), F.count_if(F.col("extracted_insight").isNull()).alias("without_insight"), F.max("upvotes").alias("most_upvotes"),
    )


def _stratum() -> Column:
    return F.concat_ws("|", F.coalesce(F.nullif("platform", F.lit("")), F.lit("unknown")), F.coalesce(F.nullif("category", F.lit("")), F.lit("uncategorised")), T.length_bucket(F.length(F.coalesce("raw_text", F.lit("")))))


def e44_strata(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("pool"))


def g08_stratified_sample(spark: SparkSession, d: str, size: int = 3) -> DataFrame:
    """The same rows of each stratum for the same seed, whatever the order or partitioning; only keys and lengths are ranked."""
    keyed = nuggets(spark, d).where("unique_key is not null").select("id", "unique_key", _stratum().alias("stratum"))
    return top_k_per(keyed, ["stratum"], [T.sample_rank(SEED, F.col("unique_key")), F.asc("unique_key"), F.asc("id")], size).select("stratum", "id")


def g09_allocation(spark: SparkSession, d: str, total: int = 150) -> DataFrame:
    """Rows to draw per stratum, in proportion, by largest remainder; the strata are platforms x categories x 3."""
    pools = {r["stratum"]: r["pool"] for r in e44_strata(spark, d).collect()}
    return spark.createDataFrame(list(proportional_sizes(pools, total).items()), "stratum string, size bigint")


def e45_keyword_labels(spark: SparkSession, d: str, k: int = 4) -> DataFrame:
    """The most frequent telling words of each category's insights; ties by the alphabet."""
    words = F.regexp_extract_all(F.lower("extracted_insight"), F.lit(r"[a-z][a-z0-9+#.-]{2,}"), F.lit(0))
    each = nuggets(spark, d).where("category is not null and extracted_insight is not null").select("category", F.explode(words).alias("word")).where(~F.col("word").isin(STOP))
    top = top_k_per(each.groupBy("category", "word").agg(F.count("*").alias("n")), ["category"], [F.desc("n"), F.asc("word")], k)
    return top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " · ").alias("label"))


def h03_hashes(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).select("id", T.short_hash(F.coalesce(F.nullif("comment_id", F.lit("")), F.col("raw_text"))).alias("fingerprint"), T.short_hash(F.col("raw_text")).alias("text_hash"))


def h04_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    parts = F.concat_ws("\x1f", F.coalesce("platform", F.lit("")), F.coalesce("community", F.lit("")), F.coalesce("raw_text", F.lit("")))
    return nuggets(spark, d).select("id", F.substring(F.sha2(parts, 256), 1, 32).alias("content_hash"))


def h05_point_ids(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).where("unique_key is not null").select("id", T.point_id(F.col("unique_key")).alias("point_id"))


def h10_retention(spark: SparkSession, d: str, days: int = 90) -> DataFrame:
    """Rows kept: those of the last ``days`` days before the newest, and those without a date."""
    n = nuggets(spark, d).withColumn("at", F.col("created_at").try_cast("timestamp"))
    n = n.crossJoin(n.agg(F.max("at").alias("newest")))  # one row
    return n.groupBy("platform").agg(F.count("*").alias("rows"), F.count_if(F.col("at").isNull() | (F.col("at") >= F.col("newest") - F.expr(f"interval {int(days)} days"))).alias("kept"))


def h11_text_retention(spark: SparkSession, d: str, days: int = 120) -> DataFrame:
    """Old rows keep their keys and lose their text and author."""
    n = nuggets(spark, d).withColumn("at", F.col("created_at").try_cast("timestamp"))
    n = n.crossJoin(n.agg(F.max("at").alias("newest")))  # one row
    old = F.coalesce(F.col("at") < F.col("newest") - F.expr(f"interval {int(days)} days"), F.lit(False))
    return n.select("id", "unique_key", F.when(~old, F.length("raw_text")).alias("text_chars"), F.when(~old, F.col("author")).alias("author"))


def h15_identify(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a community and what their address would give, by platform; a report, nothing is written."""
    found = T.community_of(F.col("source_url"))
    return nuggets(spark, d).where("community is null").groupBy("platform", F.coalesce(found, F.lit("unknown")).alias("community")).agg(F.count("*").alias("rows"))


def i14_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of whole sentences; see ``functions.chunks``."""

    def run(bs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bs:
            rows = [(i, n, c) for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()) for n, c in enumerate(chunk_text(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "chunk", "text"])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(run, "doc_id bigint, chunk int, text string")


def i15_insight_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Raw text with its insight in front, where the text does not hold it anyway."""
    i, t = F.coalesce("extracted_insight", F.lit("")), F.coalesce("raw_text", F.lit(""))
    return nuggets(spark, d).select("id", F.md5(F.when((i == "") | F.contains(t, i), t).otherwise(F.concat(i, F.lit("\n"), t))).alias("embedded_md5"))


def i18_communities(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).where("source_url is not null").select("id", T.host(F.col("source_url")).alias("host"), T.community_of(F.col("source_url")).alias("community"))


def i25_slugs(spark: SparkSession, d: str) -> DataFrame:
    return nuggets(spark, d).where("community is not null").select(T.slug(F.col("community")).alias("slug")).groupBy("slug").agg(F.count("*").alias("rows"))


def j08_length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("text_kind", T.length_bucket(F.length("text")).alias("bucket")).agg(F.count("*").alias("documents"))


def n06_reviews(spark: SparkSession, d: str) -> DataFrame:
    """One row per review, the one updated last; of equal times the greatest row."""
    r = table(spark, d, "mixed_vote_score")
    last = latest_by(r, ["recommendationid"], [F.col("timestamp_updated")])
    return last.select("recommendationid", "app_id", "timestamp_updated")


def n07_scores(spark: SparkSession, d: str) -> DataFrame:
    """The vote score as a number however it is written; unreadable ones are null, never 0."""
    s = T.number_or_text(F.col("weighted_vote_score"))
    return table(spark, d, "mixed_vote_score").groupBy("app_id").agg(F.count("*").alias("reviews"), F.count(s).alias("scored"), F.round(F.avg(s), 6).alias("mean_score"), F.round(F.avg(F.col("voted_up").cast("double")), 6).alias("positive"))


def i17_counts(spark: SparkSession, d: str) -> DataFrame:
    """Short counts written as on pages (12K, 3.5M) back as numbers: a round trip of the reviews' votes."""
    v = F.coalesce("votes_up", F.lit(0))
    shown = F.when(v >= 1000, F.concat(F.format_string("%.1f", v / 1000), F.lit("K"))).otherwise(v.cast("string"))
    return table(spark, d, "mixed_vote_score").select(T.parse_count(shown).alias("votes")).groupBy("votes").agg(F.count("*").alias("reviews"))


def m01_dashboard(spark: SparkSession, d: str) -> DataFrame:
    """All dashboard counts of the archive in one pass."""
    n = nuggets(spark, d)
    return n.agg(F.count("*").alias("nuggets"), F.count_if(F.col("trivial") == 1).alias("trivial"), F.count_distinct("thread_id").alias("threads"), F.count_distinct("community").alias("communities"), F.count_if(F.col("embedding_model").isNull()).alias("unembedded"), F.count_distinct("run_id").alias("runs"))


def m02_missing_last(spark: SparkSession, d: str, limit: int = 40) -> DataFrame:
    """Archive rows by upvotes; missing ones come last in both directions."""
    n = nuggets(spark, d).select("id", "upvotes")
    up = n.orderBy(F.asc_nulls_last("upvotes"), "id").limit(limit).withColumn("direction", F.lit("up"))
    return up.unionByName(n.orderBy(F.desc_nulls_last("upvotes"), "id").limit(limit).withColumn("direction", F.lit("down")))


def m14_table_parity(spark: SparkSession, d: str) -> DataFrame:
    """Row counts of the tables that must match between copies."""
    names = ["nuggets", "nuggets_incoming", "signals", "signals_mirror", "documents", "ingest_batch", "ingested_comments"]
    parts = [table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def n21_unique_names(spark: SparkSession, d: str) -> DataFrame:
    """Author names made unique by -2, -3, ... in the order of first appearance."""
    a = nuggets(spark, d).where("author is not null").groupBy("author").agg(F.min("id").alias("first"))
    nth = F.row_number().over(Window.partitionBy(T.slug(F.col("author"))).orderBy("first"))
    return a.select("author", F.concat(T.slug(F.col("author")), F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise("")).alias("unique_name"))


def d08_citations(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows beside the archive row of their key, with dangling ones kept."""
    n = nuggets(spark, d).where("unique_key is not null").groupBy("unique_key").agg(F.min("id").alias("nugget_id"))
    return table(spark, d, "nuggets_incoming").select("incoming_id", "unique_key").join(n, "unique_key", "left").select("incoming_id", "nugget_id", F.col("nugget_id").isNotNull().alias("resolved"))


def d10_thread_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Per batch thread: its nuggets, their newest date and how many have an insight; one aggregation, one join."""
    per = nuggets(spark, d).where("thread_id is not null").groupBy("thread_id").agg(F.count("*").alias("nuggets"), F.max("created_at").alias("newest"), F.count("extracted_insight").alias("insights"))
    b = table(spark, d, "ingest_batch").where("thread_id is not null").select("thread_id").distinct()
    return b.join(per, "thread_id", "left").select("thread_id", F.coalesce("nuggets", F.lit(0)).alias("nuggets"), "newest", F.coalesce("insights", F.lit(0)).alias("insights"))


def d23_context(spark: SparkSession, d: str) -> DataFrame:
    """Each nugget with the first nugget of its thread as its context."""
    n = nuggets(spark, d)
    first = n.where("thread_id is not null").groupBy("platform", "thread_id").agg(F.min("id").alias("context_id"))
    return n.join(first, ["platform", "thread_id"], "left").where("context_id <> id").select("id", "context_id")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_LEN = "case when length(coalesce({0}, '')) <= 280 then 'short' when length(coalesce({0}, '')) <= 1000 then 'medium' else 'long' end"
_STRATUM = "coalesce(nullif(platform, ''), 'unknown') || '|' || coalesce(nullif(category, ''), 'uncategorised') || '|' || " + _LEN.format("raw_text")
_q = lambda s: s.replace("'", "''")
_HOST = "nullif(regexp_replace(lower(regexp_extract(source_url, '^(?i:https?)://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\\.', ''), '')"
_COMM = f"case when {_HOST} like '%reddit.com' then 'r/' || nullif(regexp_extract(source_url, '/r/([A-Za-z0-9_]+)', 1), '') when {_HOST} = 'news.ycombinator.com' then 'Hacker News' when {_HOST} = 'github.com' then nullif(regexp_extract(source_url, 'github\\.com/([^/?#]+/[^/?#]+)', 1), '') when {_HOST} like '%.stackexchange.com' then regexp_replace({_HOST}, '\\.stackexchange\\.com$', '') else {_HOST} end"
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NUM = "try_cast(replace(trim(weighted_vote_score), ',', '.') as double)"
_TABLES = ["nuggets", "nuggets_incoming", "signals", "signals_mirror", "documents", "ingest_batch", "ingested_comments"]

ORACLE = {
    "a06_newest_nuggets": "select id, unique_key, category, platform, created_at from nuggets order by created_at desc nulls last, id desc limit 100",
    "c06_trivial": f"select id, case when regexp_matches(t, '{_q(T.GENERIC)}') or regexp_matches(t, '{_q(T.TOOL_SOLVES)}') then concat_ws(',', case when regexp_matches(t, '{_q(T.GENERIC)}') then 'generic' end, case when regexp_matches(t, '{_q(T.TOOL_SOLVES)}') then 'tool_solves' end) when regexp_matches(t, '{_q(T.SPECIFIC)}') then '' else 'vague' end reasons from (select id, coalesce(raw_text, '') t from nuggets)",
    "c14_archive_page": "select id, platform, category from nuggets where contains(lower(coalesce(raw_text, '')), 'spreadsheet') or contains(lower(coalesce(extracted_insight, '')), 'spreadsheet') or contains(lower(coalesce(author, '')), 'spreadsheet') order by id desc limit 50 offset 10",
    "c16_flags": "select platform, count(*) filter (trivial = 1) as trivial, count(*) filter (embedding_model is null) reembed, count(*) filter (embedding_model = 'fake (hash)') stand_in, count(*) filter (author is null) no_author, count(*) filter (extracted_insight is null) no_insight, count(*) filter (thread_id is null) no_thread from nuggets group by platform",
    "c17_search": "select id from nuggets where contains(lower(raw_text), '($')",
    "e28_thread_stats": "select thread_id, count(*) members, count(distinct lower(author)) authors, count(*) filter (author is null) unknown_authors, coalesce(array_to_string(list_sort(list_distinct(list(platform))), ','), '') platforms, count(distinct lower(author)) = 1 and count(*) filter (author is null) = 0 single_author from nuggets where thread_id is not null group by thread_id",
    "e29_posts": "select platform, thread_id, max(coalesce(created_utc, created_at)) newest, count(*) as rows, count(*) filter (extracted_insight is null) without_insight, max(upvotes) most_upvotes from nuggets group by all",
    "e44_strata": f"select {_STRATUM} stratum, count(*) pool from nuggets group by 1",
    "g08_stratified_sample": f"select stratum, id from (select id, unique_key, {_STRATUM} stratum from nuggets where unique_key is not null) qualify row_number() over (partition by stratum order by sha256(concat('{SEED}', chr(0), unique_key)), unique_key, id) <= 3",
    "e45_keyword_labels": "with w as (select category, unnest(regexp_extract_all(lower(extracted_insight), '[a-z][a-z0-9+#.-]{2,}')) word from nuggets where category is not null and extracted_insight is not null), c as (select category, word, count(*) n from w where word not in (" + ", ".join(f"'{_q(x)}'" for x in STOP) + ") group by all), r as (select *, row_number() over (partition by category order by n desc, word) rn from c) select category, string_agg(word, ' · ' order by rn) as label from r where rn <= 4 group by category",
    "h03_hashes": "select id, substr(sha1(coalesce(nullif(comment_id, ''), raw_text)), 1, 16) fingerprint, substr(sha1(raw_text), 1, 16) text_hash from nuggets",
    "h04_content_hashes": "select id, substr(sha256(coalesce(platform, '') || chr(31) || coalesce(community, '') || chr(31) || coalesce(raw_text, '')), 1, 32) content_hash from nuggets",
    "h05_point_ids": "select id, cast(cast('0x' || substr(sha256(unique_key), 1, 16) as ubigint) & 9223372036854775807 as bigint) point_id from nuggets where unique_key is not null",
    "h10_retention": "with n as (select platform, try_cast(created_at as timestamp) t from nuggets) select platform, count(*) as rows, count(*) filter (t is null or t >= (select max(t) from n) - interval 90 day) kept from n group by platform",
    "h11_text_retention": "with n as (select *, coalesce(try_cast(created_at as timestamp) < (select max(try_cast(created_at as timestamp)) from nuggets) - interval 120 day, false) o from nuggets) select id, unique_key, case when not o then length(raw_text) end text_chars, case when not o then author end author from n",
    "h15_identify": f"select platform, coalesce({_COMM}, 'unknown') community, count(*) as rows from nuggets where community is null group by 1, 2",
    "i15_insight_prefix": "select id, md5(case when i = '' or contains(t, i) then t else i || chr(10) || t end) embedded_md5 from (select id, coalesce(extracted_insight, '') i, coalesce(raw_text, '') t from nuggets)",
    "i18_communities": f"select id, {_HOST} host, {_COMM} community from nuggets where source_url is not null",
    "i25_slugs": f"select {_SLUG.format('community')} slug, count(*) as rows from nuggets where community is not null group by 1",
    "j08_length_buckets": f"select text_kind, {_LEN.format('text')} bucket, count(*) documents from documents group by 1, 2",
    "n06_reviews": "select recommendationid, arg_max(app_id, timestamp_updated) app_id, max(timestamp_updated) timestamp_updated from mixed_vote_score group by 1",
    "n07_scores": f"select app_id, count(*) reviews, count({_NUM}) scored, round(avg({_NUM}), 6) mean_score, round(avg(voted_up::double), 6) positive from mixed_vote_score group by app_id",
    "i17_counts": "select cast(case when v >= 1000 then round(round(v / 1000.0, 1) * 1000) else v end as bigint) votes, count(*) reviews from (select coalesce(votes_up, 0) v from mixed_vote_score) group by 1",
    "m01_dashboard": "select count(*) nuggets, count(*) filter (trivial = 1) as trivial, count(distinct thread_id) threads, count(distinct community) communities, count(*) filter (embedding_model is null) unembedded, count(distinct run_id) runs from nuggets",
    "m02_missing_last": "(select id, upvotes, 'up' direction from nuggets order by upvotes asc nulls last, id limit 40) union all (select id, upvotes, 'down' from nuggets order by upvotes desc nulls last, id limit 40)",
    "m14_table_parity": " union all ".join(f"select '{t}' table_name, count(*) as rows from {t}" for t in _TABLES),
    "n21_unique_names": f"with a as (select author, min(id) f from nuggets where author is not null group by author), r as (select author, {_SLUG.format('author')} s, row_number() over (partition by {_SLUG.format('author')} order by f) n from a) select author, s || case when n > 1 then '-' || n else '' end unique_name from r",
    "d08_citations": "select incoming_id, nugget_id, nugget_id is not null resolved from nuggets_incoming i left join (select unique_key, min(id) nugget_id from nuggets where unique_key is not null group by 1) n on n.unique_key = i.unique_key",
    "d10_thread_scalars": "select thread_id, (select count(*) from nuggets n where n.thread_id = b.thread_id) nuggets, (select max(created_at) from nuggets n where n.thread_id = b.thread_id) newest, (select count(extracted_insight) from nuggets n where n.thread_id = b.thread_id) insights from (select distinct thread_id from ingest_batch where thread_id is not null) b",
    "d23_context": "select n.id, f.context_id from nuggets n join (select platform, thread_id, min(id) context_id from nuggets where thread_id is not null group by all) f on f.platform = n.platform and f.thread_id = n.thread_id where f.context_id <> n.id",
}
