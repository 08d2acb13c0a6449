"""The tables read as streams; each result equals that of one batch over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table
from tidemark.streaming import operators as S
from tidemark.streaming.runs import drained, file_stream


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return file_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema)


def l01_queue_handoff(spark: SparkSession, d: str) -> DataFrame:
    """Pending comment batches handed on once each; offsets take the place of a status column."""
    pending = _stream(spark, d, "ingest_batch").where("status = 'pending' and kind = 'comment'")
    return drained(pending.select("id", "platform", F.coalesce(F.json_array_length("comments"), F.lit(0)).alias("comments")), "handoff")


def l02_first_sightings(spark: SparkSession, d: str) -> DataFrame:
    seen = _stream(spark, d, "ingested_comments").select(F.lower(F.trim("fingerprint")).alias("fingerprint"))
    return drained(S.first_sightings(seen, "fingerprint"), "sightings")


def l03_keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sightings of every mirrored record folded to its dates, sightings and revisions."""
    m = _stream(spark, d, "signals_mirror").select("record_id", F.unix_millis("last_seen_utc").alias("at"), F.col("text_hash").alias("text"), F.lit(False).alias("removed"))
    return drained(S.keyed_upsert(m), "upsert", "update")


def l10_threads(spark: SparkSession, d: str) -> DataFrame:
    """The newest batch of every thread and how many it had; a fetcher skips threads that advertise no more."""
    return drained(S.latest_per_key(_stream(spark, d, "ingest_batch").select("thread_id", "id"), "thread_id", "id"), "threads", "complete")


def l12_stream_days(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling days of events with a watermark of two days."""
    e = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 days")
    days = e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"))
    return drained(days, "days", "complete").select(F.to_date("w.start").alias("day"), "event_type", "events")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] == "l" and k[1:3].isdigit() and v.__module__ == __name__}

ORACLE = {
    "l01_queue_handoff": "select id, platform, cast(coalesce(case when json_valid(comments) then json_array_length(comments) end, 0) as integer) comments from ingest_batch where status = 'pending' and kind = 'comment'",
    "l02_first_sightings": "select distinct lower(trim(fingerprint)) fingerprint from ingested_comments where fingerprint is not null",
    "l03_keyed_upsert": "with s as (select record_id, epoch_ms(last_seen_utc) t, text_hash x, lag(text_hash) over (partition by record_id order by last_seen_utc, text_hash) p, row_number() over (partition by record_id order by last_seen_utc, text_hash) n from signals_mirror where record_id is not null) select record_id, min(t) first_seen, max(t) last_seen, count(*) sightings, count(*) filter (n > 1 and x is distinct from p) revisions, false removed from s group by record_id",
    "l10_threads": "select thread_id, max(id) id, count(*) as rows from ingest_batch where thread_id is not null group by thread_id",
    "l12_stream_days": "select cast(ts as date) as day, event_type, count(*) events from events group by all",
}
