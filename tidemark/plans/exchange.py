"""Exports and their manifests, JSON Lines round trips, evaluation of stored ratings, plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import text as T
from tidemark.operators import evaluation as E
from tidemark.plans.signals import archive
from tidemark.session import new_folder, table
from tidemark.sources import export, jsonl


def b01_export_signals(spark: SparkSession, d: str) -> DataFrame:
    """The archive written as CSV with a manifest and read back, with what the manifest says."""
    s = table(spark, d, "signals")
    m = export.export_csv(s, new_folder(spark, "export"), "record_id", rows_per_file=100_000)
    return spark.createDataFrame([("signals", m["rows"], m["ids"], len(m["columns"]))], "table_name string, rows bigint, ids bigint, columns bigint")


def b02_export_archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive without repeated texts, one folder of shards per platform, read back as rows per platform."""
    n = table(spark, d, "nuggets")
    first = n.groupBy(T.squeezed(F.coalesce("raw_text", F.lit(""))).alias("k")).agg(F.min("id").alias("id")).select("id")
    kept = n.join(first, "id", "left_semi").select("id", "platform", "category", "raw_text")
    folder = new_folder(spark, "export")
    export.export_csv(kept, folder, "id", by=["platform"], rows_per_file=50_000)
    return export.read_csv(spark, folder, kept).groupBy("platform").agg(F.count("*").alias("rows"), F.sum(F.length("raw_text")).alias("chars"))


def b15_jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Incoming rows written as JSON Lines and read back with bad lines counted."""
    folder = new_folder(spark, "jsonl")
    jsonl.to_jsonl(table(spark, d, "nuggets_incoming").select("incoming_id", "unique_key", "upvotes"), folder)
    r = jsonl.read_jsonl(spark, folder, "incoming_id bigint, unique_key string, upvotes int")
    return r.agg(F.count("*").alias("lines"), F.count_if("bad").alias("bad"), F.count("unique_key").alias("keys"), F.sum("upvotes").alias("upvotes"))


def b06_evolved(spark: SparkSession, d: str) -> DataFrame:
    """Two archives of different columns as one: missing fields are null, none is dropped or retyped."""
    a, b = table(spark, d, "nuggets").drop("replies", "community"), table(spark, d, "nuggets_incoming").withColumnRenamed("incoming_id", "id")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy(F.col("batch_no").isNull().alias("archived")).agg(F.count("*").alias("rows"), F.count("replies").alias("with_replies"), F.count("community").alias("with_community"))


def e41_extraction(spark: SparkSession, d: str) -> DataFrame:
    """The stored trivial flag against the rules' own verdict, by platform."""
    n = table(spark, d, "nuggets").withColumn("rule", F.size(T.trivial_reasons(F.col("raw_text"))) > 0)
    return E.precision_recall(n, F.col("rule"), F.col("trivial") == 1, ["platform"])


def e42_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement beyond chance of the reviews' verdict with that of their score."""
    score = T.number_or_text(F.col("weighted_vote_score"))
    return E.cohens_kappa(table(spark, d, "mixed_vote_score"), F.col("voted_up").cast("int"), (score >= 0.5).cast("int"), ["review_lang"])


def e43_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute difference of the reviews' counters, each axis over the rows that have both."""
    axes = {"votes_comments": (F.col("votes_up"), F.col("comment_count")), "update_days": (F.col("timestamp_created") / 86400, F.col("timestamp_updated") / 86400)}
    return E.mean_absolute_error(table(spark, d, "mixed_vote_score"), axes)


def i09_plain(spark: SparkSession, d: str) -> DataFrame:
    """Documents wrapped as a page and read back as plain text: how many come out as they were."""
    page = F.concat(F.lit("<html><style>p {}</style><p>"), F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</p><script>x()</script></html>"))
    docs = table(spark, d, "documents").where("text is not null").select("text_kind", F.col("text"), H.plain(page).alias("plain"))
    same = T.squeezed(F.col("text")) == T.squeezed(F.col("plain"))
    return docs.groupBy("text_kind").agg(F.count("*").alias("documents"), F.count_if(same).alias("same"))


def b05_coerced(spark: SparkSession, d: str) -> DataFrame:
    """The archive's row as the analytic copy stores it: dates typed, empty ones null, numbers never null."""
    a = archive(spark, d)
    return a.select("record_id", "first_seen_utc", "removed_utc", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce("revisions", F.lit(0)).alias("revisions"), F.round(F.coalesce("match_confidence", F.lit(0.0)), 4).alias("match_confidence"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_S = lambda x: f"trim(regexp_replace(lower({x}), '[\\s\\p{{Z}}]+', ' ', 'g'))"
_q = lambda s: s.replace("'", "''")
_NUM = "try_cast(replace(trim(weighted_vote_score), ',', '.') as double)"
_RULE = f"(regexp_matches(t, '{_q(T.GENERIC)}') or regexp_matches(t, '{_q(T.TOOL_SOLVES)}') or not regexp_matches(t, '{_q(T.SPECIFIC)}'))"
_UTC = lambda c: f"try_cast(nullif({c}, '') as timestamptz) at time zone 'UTC' {c}"
ORACLE = {
    "b01_export_signals": "select 'signals' table_name, count(*) as rows, count(distinct record_id) ids, cast(30 as bigint) as columns from signals",
    "b02_export_archive": f"with f as (select min(id) id from nuggets group by {_S('coalesce(raw_text, chr(39) || chr(39))').replace('chr(39) || chr(39)', chr(39) * 2)}) select platform, count(*) as rows, cast(sum(length(raw_text)) as bigint) chars from nuggets where id in (select id from f) group by platform",
    "b15_jsonl_round_trip": "select count(*) as lines, cast(0 as bigint) bad, count(unique_key) keys, cast(sum(upvotes) as bigint) upvotes from nuggets_incoming",
    "b06_evolved": "select true archived, count(*) as rows, cast(0 as bigint) with_replies, cast(0 as bigint) with_community from nuggets union all select false, count(*), count(replies), count(community) from nuggets_incoming",
    "e41_extraction": f"with n as (select platform, coalesce(trivial = 1, false) a, {_RULE} p from (select *, coalesce(raw_text, '') t from nuggets)), c as (select platform, count(*) filter (p and a) tp, count(*) filter (p and not a) fp, count(*) filter (not p and a) fn from n group by platform) select platform, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) f1 from c",
    "e42_kappa": f"with r as (select review_lang, voted_up::int::double a, ({_NUM} >= 0.5)::int::double b from mixed_vote_score where voted_up is not null and {_NUM} is not null), g as (select review_lang, count(*) n, avg((a = b)::int::double) o, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) e from r group by review_lang) select review_lang, n, round(o, 6) agreement, round(case when e < 1 then (o - e) / (1 - e) end, 6) kappa from g",
    "e43_agreement": "select 'votes_comments' axis, count(abs(votes_up - comment_count)) n, round(avg(abs(votes_up - comment_count)::double), 6) mae from mixed_vote_score union all select 'update_days', count(abs(timestamp_created - timestamp_updated)), round(avg(abs(timestamp_created / 86400 - timestamp_updated / 86400)), 6) from mixed_vote_score",
    "b05_coerced": f"select record_id, {_UTC('first_seen_utc')}, {_UTC('removed_utc')}, coalesce(relevant, 0) relevant, coalesce(revisions, 0) revisions, round(coalesce(match_confidence, 0), 4) match_confidence from signals",
}
