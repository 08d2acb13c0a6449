"""Signal archive: newest versions, counts, daily and community tables, leads, reconciliation and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.compare import instant_millis
from tidemark.operators.relational import empty_as_null, keyed_merge, latest_by, top_k_per, zero_filled_days
from tidemark.operators.rules import matched_phrases
from tidemark.session import table

TIMES = ["created_utc", "edited_utc", "removed_utc", "first_seen_utc", "last_seen_utc", "outcome_at"]
#: Platforms whose permalink is the way to answer.
REPLY_PLATFORMS = ["reddit", "lemmy"]
#: What counts as a way to reach the author; every repetition is bounded. Fixed values.
CONTACT = r"(?i)[\w.+-]{1,64}@[\w-]{1,63}(\.[\w-]{1,63}){1,4}|https?://[^\s|)\]]{1,300}|\bapply\b|\bcareers\b|\bemail\b|\bcontact\b|\bDM\b|\breach out\b"
EMAIL = r"[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,4}"
EXCERPT_CHARS = 600


def newest(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of every mirrored record, empty text as null."""
    m = table(spark, d, "signals_mirror")
    return _nulled(latest_by(m, ["record_id"], [F.col("last_seen_utc")]))


def _nulled(df: DataFrame) -> DataFrame:
    return df.select(*[empty_as_null(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive with empty text as null and times as UTC instants."""
    s = _nulled(table(spark, d, "signals"))
    return s.withColumns({c: F.timestamp_millis(instant_millis(F.col(c))) for c in TIMES})


def _is(c: str, value: str) -> Column:
    return F.col(c) == value


def e01_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Rows after versions are resolved, rows stored, distinct ids and their differences."""
    m = table(spark, d, "signals_mirror")
    final = newest(spark, d).agg(F.count("*").alias("rows_final"))
    raw = m.agg(F.count("*").alias("rows_raw"), F.count_distinct("record_id").alias("unique_ids"))
    return final.crossJoin(raw).selectExpr("rows_final", "rows_raw", "unique_ids", "rows_final - unique_ids as duplicates", "rows_raw - rows_final as superseded")  # one row each


def e02_counts_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d).groupBy("mode").agg(
        F.count("*").alias("records"), F.sum("relevant").alias("relevant"), F.count_if(_is("audience", "buyer")).alias("buyer"),
        F.count_if(_is("audience", "practitioner")).alias("practitioner"), F.count_if(F.col("run_status") != "ok").alias("errors"),
        F.count_if(F.col("edited_utc").isNotNull()).alias("edited"), F.count_if(F.col("removed_utc").isNotNull()).alias("removed"),
        F.min("first_seen_utc").alias("first_collected"), F.max("last_seen_utc").alias("last_collected"),
    )


def e03_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d).select("record_id", "mode", "community", "audience", "last_seen_utc")


def e04_daily_collection(spark: SparkSession, d: str) -> DataFrame:
    return newest(spark, d).groupBy(F.to_date("first_seen_utc").alias("collected_on"), "mode").agg(
        F.count("*").alias("records"), F.count_if(_is("audience", "buyer")).alias("buyer"), F.count_if(_is("audience", "practitioner")).alias("practitioner"),
        F.count_if(F.col("run_status") != "ok").alias("errors"), F.count_distinct("run_id").alias("runs"),
    )


def e05_audience_by_community(spark: SparkSession, d: str) -> DataFrame:
    buyer = F.count_if(_is("audience", "buyer"))
    return newest(spark, d).where("mode = 'live'").groupBy("community").agg(
        F.count("*").alias("records"), buyer.alias("buyer"), F.count_if(_is("audience", "practitioner")).alias("practitioner"), F.round(buyer / F.count("*"), 4).alias("buyer_rate"),
        F.round(F.avg(F.when(_is("audience", "buyer"), F.col("match_confidence").cast("double"))), 3).alias("avg_buyer_confidence"),
    )


def e06_buyer_signals(spark: SparkSession, d: str, limit: int = 200) -> DataFrame:
    """The newest ``limit`` buyer records still there, with the reason they were kept."""
    b = newest(spark, d).where("audience = 'buyer' and mode = 'live' and removed_utc is null")
    return b.orderBy(F.desc("first_seen_utc"), F.desc("match_confidence"), "record_id").limit(limit).select("record_id", "first_seen_utc", "community", "kind", "title", "match_reason", "source_url", "query")


def e07_edits_and_removals(spark: SparkSession, d: str) -> DataFrame:
    changed = newest(spark, d).where("revisions > 0 or edited_utc is not null or removed_utc is not null")
    return changed.select("record_id", "community", "revisions", "first_seen_utc", "edited_utc", "removed_utc", F.coalesce("removed_utc", "edited_utc").alias("changed_utc"))


def e08_failures(spark: SparkSession, d: str) -> DataFrame:
    bad = newest(spark, d).where("run_status <> 'ok'")
    return bad.groupBy(F.to_date("first_seen_utc").alias("collected_on"), "community", "error").agg(F.count("*").alias("records"), F.max("last_seen_utc").alias("last_attempt"))


def e09_archive_counts(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).groupBy("mode").agg(
        F.count("*").alias("unique_collected"), F.sum("relevant").alias("relevant"), F.count_if(_is("audience", "buyer")).alias("buyer"),
        F.count_if(_is("audience", "practitioner")).alias("practitioner"), F.count_if(F.col("removed_utc").isNotNull()).alias("removed"), F.count_if(F.col("run_status") != "ok").alias("errors"),
    )


def e10_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Buyer records by outcome, with the share of all buyers."""
    o = archive(spark, d).where("audience = 'buyer'").groupBy(F.coalesce("outcome", F.lit("untouched")).alias("outcome")).agg(F.count("*").alias("records"))
    worked = ~F.col("outcome").isin("untouched", "picked")
    return o.select("outcome", "records", worked.alias("worked"), F.round(F.col("records") / F.sum("records").over(Window.partitionBy()), 6).alias("share"))


def e11_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Counts by mode in both copies and whether they agree."""
    measures = [F.count("*").alias("n"), F.coalesce(F.sum("relevant"), F.lit(0)).alias("relevant"), F.count_if(_is("audience", "buyer")).alias("buyer")]
    a, b = archive(spark, d).groupBy("mode").agg(*measures), newest(spark, d).groupBy("mode").agg(*measures)
    both = a.alias("a").join(b.alias("b"), F.col("a.mode").eqNullSafe(F.col("b.mode")), "full_outer")
    same = [F.coalesce(f"a.{c}", F.lit(0)) == F.coalesce(f"b.{c}", F.lit(0)) for c in ("n", "relevant", "buyer")]
    out = [F.coalesce(f"{s}.{c}", F.lit(0)).alias(f"{n}_{c}") for s, n in (("a", "archive"), ("b", "mirror")) for c in ("n", "relevant", "buyer")]
    return both.select(F.coalesce("a.mode", "b.mode").alias("mode"), *out, (same[0] & same[1] & same[2]).alias("agrees"))


def e12_crossposts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several records share, with their records and communities; reported, never merged."""
    s = archive(spark, d).where("text_hash is not null").groupBy("text_hash")
    out = s.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("record_id")), ",").alias("record_ids"), F.array_join(F.sort_array(F.collect_set("community")), ",").alias("communities"))
    return out.where("n > 1")


def e13_digest(spark: SparkSession, d: str, days: int = 7) -> DataFrame:
    """The conditional counts of the last ``days`` days before the newest first sighting."""
    s = archive(spark, d).where("mode = 'live'")
    end = s.agg(F.max("first_seen_utc").alias("end"))
    week = s.crossJoin(end).where(F.col("first_seen_utc") >= F.col("end") - F.expr(f"interval {int(days)} days"))  # one row
    has = lambda w: F.count_if(F.contains("match_reason", F.lit(w)))
    return week.agg(
        F.count("*").alias("collected"), F.count_if(_is("audience", "buyer")).alias("buyer"), F.count_if(_is("audience", "practitioner")).alias("practitioner"), F.count_if(_is("audience", "none")).alias("rejected"),
        has("ambiguous").alias("ambiguous"), has("inherited").alias("inherited"), F.count_if(F.col("run_status") != "ok").alias("errors"), F.count_if(F.col("edited_utc").isNotNull()).alias("edited"),
        F.count_if(F.col("removed_utc").isNotNull()).alias("removed"), F.count_distinct("community").alias("communities"),
    )


def i05_matched_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases read back from the stored reason, with their records; one mention counts as once."""
    phrases = F.array_distinct(matched_phrases(F.col("match_reason")))
    each = archive(spark, d).select("record_id", F.explode(phrases).alias("phrase"))
    return each.groupBy("phrase").agg(F.count("*").alias("records")).withColumn("repeated", F.col("records") >= 2)


def e14_measured_yield(spark: SparkSession, d: str) -> DataFrame:
    """Per platform: records, buyers, buyers of the last 30 days of the archive, distinct companies."""
    s = archive(spark, d)
    s = s.crossJoin(s.agg(F.max("first_seen_utc").alias("end")))  # one row
    buyer = _is("audience", "buyer")
    company = F.when(buyer & (F.lower(F.trim("company")) != "unknown"), F.lower(F.trim("company")))
    return s.groupBy("platform").agg(
        F.count("*").alias("records"), F.count_if(buyer).alias("buyers"), F.count_if(buyer & (F.col("first_seen_utc") >= F.col("end") - F.expr("interval 30 days"))).alias("recent_buyers"), F.count_distinct(company).alias("companies"),
    )


def e15_companies(spark: SparkSession, d: str) -> DataFrame:
    """Per named company: records, latest sighting and the record of highest confidence."""
    named = archive(spark, d).where("company is not null and lower(trim(company)) <> 'unknown'").withColumn("name", F.lower(F.trim("company")))
    best = F.max(F.struct(F.coalesce("match_confidence", F.lit(-1.0)).alias("c"), F.col("record_id")))
    return named.groupBy("name").agg(F.count("*").alias("records"), F.max("last_seen_utc").alias("last_seen"), best["record_id"].alias("best_record"))


def e16_best_per_headline(spark: SparkSession, d: str) -> DataFrame:
    s = archive(spark, d).where("title is not null").withColumn("headline", F.substring(F.lower(F.trim("title")), 1, 80))
    top = top_k_per(s, ["headline"], [F.desc_nulls_last("match_confidence"), F.asc("record_id")], 1)
    return top.select("headline", "record_id", "community")


def g01_leads(spark: SparkSession, d: str) -> DataFrame:
    """Buyer records someone can act on today, ranked; reachability and age are columns, so nothing is dropped in silence."""
    s = archive(spark, d).where("audience = 'buyer' and removed_utc is null")
    s = s.crossJoin(s.agg(F.max("first_seen_utc").alias("now")))  # one row
    reachable = F.when(F.col("platform").isin(REPLY_PLATFORMS), F.col("source_url").isNotNull()).otherwise(F.coalesce(F.regexp_like("excerpt", F.lit(CONTACT)), F.lit(False)))
    old = F.coalesce(F.to_date("created_utc") < F.date_sub(F.to_date("now"), 60), F.lit(False))
    picked = F.coalesce(_is("outcome", "picked"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc(picked), F.desc_nulls_last("match_confidence"), F.desc("first_seen_utc"), "record_id"))
    return s.select("mode", "record_id", reachable.alias("reachable"), old.alias("too_old"), rank.alias("rank"))


def i22_routes(spark: SparkSession, d: str) -> DataFrame:
    """The first address and link of each excerpt; one that ends where a cut excerpt ends is left out."""
    s = archive(spark, d).where("excerpt is not null")

    def route(p: str) -> Column:
        m = F.regexp_substr("excerpt", F.lit(p))
        touches = F.endswith("excerpt", m) & (F.length("excerpt") >= EXCERPT_CHARS) & (F.instr(F.col("excerpt"), m) + F.length(m) - 1 == F.length("excerpt"))
        return F.when(m.isNull() | touches, "").otherwise(m)

    return s.select("record_id", route(EMAIL).alias("email"), route(r"https?://[^\s|)\]]{1,300}").alias("link"))


def e30_facets(spark: SparkSession, d: str) -> DataFrame:
    """Counts per facet value with the facet's own filter dropped (mode live, audience buyer), in one pass."""
    filters = {"mode": "live", "audience": "buyer"}
    facets = ["mode", "audience", "platform", "kind"]
    s = archive(spark, d)
    others = [F.when(_all(filters, f), F.struct(F.lit(f).alias("facet"), F.col(f).alias("value"))) for f in facets]
    each = s.select(F.explode(F.array_compact(F.array(*others))).alias("x")).select("x.*").where("value is not null")
    counts = each.groupBy("facet", "value").agg(F.count("*").alias("n"))
    return top_k_per(counts, ["facet"], [F.desc("n"), F.asc("value")], 60).select("facet", "value", "n")


def _all(filters: dict[str, str], but: str) -> Column:
    keep = F.lit(True)
    for c, v in filters.items():
        if c != but:
            keep = keep & F.coalesce(F.col(c) == v, F.lit(False))
    return keep


def e31_sparkline(spark: SparkSession, d: str) -> DataFrame:
    """Records and buyers per day of first sighting, days without any as zero."""
    days = archive(spark, d).groupBy(F.to_date("first_seen_utc").alias("day")).agg(F.count("*").alias("records"), F.count_if(_is("audience", "buyer")).alias("buyers")).where("day is not null")
    return zero_filled_days(days, "day", ["records", "buyers"])


def b10_merge(spark: SparkSession, d: str) -> DataFrame:
    """What a keyed merge of the mirror's newest versions into the archive would do to each record."""
    compared = ["title", "excerpt", "text_hash", "audience", "community"]
    return keyed_merge(table(spark, d, "signals"), newest(spark, d), "record_id", compared)


def d07_mark_closed(spark: SparkSession, d: str) -> DataFrame:
    """Per community, records that a complete newer read no longer holds; no community loses over half of more than 20."""
    a = archive(spark, d).where("removed_utc is null").select("record_id", "community")
    gone = a.join(newest(spark, d).select("record_id"), "record_id", "left_anti").withColumn("gone", F.lit(1))
    share = a.groupBy("community").agg(F.count("*").alias("open_records")).join(gone.groupBy("community").agg(F.count("*").alias("missing")), "community")
    return share.withColumn("guarded", (F.col("open_records") > 20) & (F.col("missing") > F.col("open_records") * 0.5))


def j01_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Every spelling of the sighting time as epoch milliseconds; unreadable ones stay null."""
    return table(spark, d, "signals").select("record_id", instant_millis(F.col("first_seen_utc")).alias("first_seen_ms"), instant_millis(F.col("last_seen_utc")).alias("last_seen_ms"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_T = lambda c: f"epoch_ms(try_cast({c} as timestamptz))"
_ARCHIVE = "a as (select * replace (" + ", ".join(f"try_cast(nullif({c}, '') as timestamptz) at time zone 'UTC' as {c}" for c in TIMES) + ", " + ", ".join(
    f"nullif({c}, '') as {c}" for c in "mode platform source_url community kind title excerpt text_hash match_reason audience company run_status outcome".split()) + ") from signals)"
_NEWEST = "m as (select * replace (" + ", ".join(f"nullif({c}, '') as {c}" for c in "mode platform source_url community kind title excerpt text_hash match_reason audience company run_status outcome error query run_id".split()) + ", " + ", ".join(f"{c} at time zone 'UTC' as {c}" for c in TIMES) + ") from signals_mirror qualify row_number() over (partition by record_id order by last_seen_utc desc) = 1)"
_STAMP = lambda c: f"{c} at time zone 'UTC'"

ORACLE = {
    "e01_reconciliation": "select count(distinct record_id) rows_final, count(*) rows_raw, count(distinct record_id) unique_ids, cast(0 as bigint) duplicates, count(*) - count(distinct record_id) superseded from signals_mirror",
    "e02_counts_by_mode": f"with {_NEWEST} select mode, count(*) records, cast(sum(relevant) as bigint) relevant, count(*) filter (audience = 'buyer') buyer, count(*) filter (audience = 'practitioner') practitioner, count(*) filter (run_status <> 'ok') errors, count(edited_utc) edited, count(removed_utc) removed, min(first_seen_utc) first_collected, max(last_seen_utc) last_collected from m group by mode",
    "e03_latest_versions": f"with {_NEWEST} select record_id, mode, community, audience, last_seen_utc from m",
    "e04_daily_collection": f"with {_NEWEST} select cast(first_seen_utc as date) collected_on, mode, count(*) records, count(*) filter (audience = 'buyer') buyer, count(*) filter (audience = 'practitioner') practitioner, count(*) filter (run_status <> 'ok') errors, count(distinct run_id) runs from m group by all",
    "e05_audience_by_community": f"with {_NEWEST} select community, count(*) records, count(*) filter (audience = 'buyer') buyer, count(*) filter (audience = 'practitioner') practitioner, round(count(*) filter (audience = 'buyer') / count(*), 4) buyer_rate, round(avg(cast(match_confidence as double)) filter (audience = 'buyer'), 3) avg_buyer_confidence from m where mode = 'live' group by community",
    "e06_buyer_signals": f"with {_NEWEST} select record_id, first_seen_utc, community, kind, title, match_reason, source_url, query from m where audience = 'buyer' and mode = 'live' and removed_utc is null order by first_seen_utc desc, match_confidence desc, record_id limit 200",
    "e07_edits_and_removals": f"with {_NEWEST} select record_id, community, revisions, first_seen_utc, edited_utc, removed_utc, coalesce(removed_utc, edited_utc) changed_utc from m where revisions > 0 or edited_utc is not null or removed_utc is not null",
    "e08_failures": f"with {_NEWEST} select cast(first_seen_utc as date) collected_on, community, error, count(*) records, max(last_seen_utc) last_attempt from m where run_status <> 'ok' group by all",
    "e09_archive_counts": f"with {_ARCHIVE} select mode, count(*) unique_collected, cast(sum(relevant) as bigint) relevant, count(*) filter (audience = 'buyer') buyer, count(*) filter (audience = 'practitioner') practitioner, count(removed_utc) removed, count(*) filter (run_status <> 'ok') errors from a group by mode",
    "e10_outcomes": f"with {_ARCHIVE} select outcome, records, outcome not in ('untouched', 'picked') worked, round(records / sum(records) over (), 6) share from (select coalesce(outcome, 'untouched') outcome, count(*) records from a where audience = 'buyer' group by 1)",
    "e11_reconcile": f"with {_ARCHIVE}, {_NEWEST}, x as (select mode, count(*) n, coalesce(sum(relevant), 0) relevant, count(*) filter (audience = 'buyer') buyer from a group by mode), y as (select mode, count(*) n, coalesce(sum(relevant), 0) relevant, count(*) filter (audience = 'buyer') buyer from m group by mode) select coalesce(x.mode, y.mode) mode, coalesce(x.n, 0) archive_n, cast(coalesce(x.relevant, 0) as bigint) archive_relevant, coalesce(x.buyer, 0) archive_buyer, coalesce(y.n, 0) mirror_n, cast(coalesce(y.relevant, 0) as bigint) mirror_relevant, coalesce(y.buyer, 0) mirror_buyer, coalesce(x.n, 0) = coalesce(y.n, 0) and coalesce(x.relevant, 0) = coalesce(y.relevant, 0) and coalesce(x.buyer, 0) = coalesce(y.buyer, 0) agrees from x full join y on x.mode is not distinct from y.mode",
    "e12_crossposts": f"with {_ARCHIVE} select text_hash, count(*) n, string_agg(record_id, ',' order by record_id) record_ids, coalesce(array_to_string(list_sort(list_distinct(list(community))), ','), '') communities from a where text_hash is not null group by text_hash having count(*) > 1",
    "e13_digest": f"with {_ARCHIVE}, w as (select * from a where mode = 'live' and first_seen_utc >= (select max(first_seen_utc) from a where mode = 'live') - interval 7 days) select count(*) collected, count(*) filter (audience = 'buyer') buyer, count(*) filter (audience = 'practitioner') practitioner, count(*) filter (audience = 'none') rejected, count(*) filter (contains(match_reason, 'ambiguous')) ambiguous, count(*) filter (contains(match_reason, 'inherited')) inherited, count(*) filter (run_status <> 'ok') errors, count(edited_utc) edited, count(removed_utc) removed, count(distinct community) communities from w",
    "i05_matched_phrases": f"with {_ARCHIVE}, p as (select distinct record_id, trim(unnest(string_split(regexp_extract(match_reason, '\\[matched: ([^\\]]*)\\]', 1), ','))) phrase from a) select phrase, count(*) records, count(*) >= 2 repeated from p where phrase <> '' group by phrase",
    "e14_measured_yield": f"with {_ARCHIVE} select platform, count(*) records, count(*) filter (audience = 'buyer') buyers, count(*) filter (audience = 'buyer' and first_seen_utc >= (select max(first_seen_utc) from a) - interval 30 days) recent_buyers, count(distinct case when audience = 'buyer' and lower(trim(company)) <> 'unknown' then lower(trim(company)) end) companies from a group by platform",
    "e15_companies": f"with {_ARCHIVE} select lower(trim(company)) as name, count(*) records, max(last_seen_utc) last_seen, arg_max(record_id, (coalesce(match_confidence, -1.0), record_id)) best_record from a where company is not null and lower(trim(company)) <> 'unknown' group by 1",
    "e16_best_per_headline": f"with {_ARCHIVE} select substr(lower(trim(title)), 1, 80) headline, record_id, community from a where title is not null qualify row_number() over (partition by substr(lower(trim(title)), 1, 80) order by match_confidence desc nulls last, record_id) = 1",
    "g01_leads": f"with {_ARCHIVE}, s as (select * from a where audience = 'buyer' and removed_utc is null) select mode, record_id, case when platform in ('reddit', 'lemmy') then source_url is not null else coalesce(regexp_matches(excerpt, '{CONTACT}'), false) end reachable, coalesce(cast(created_utc as date) < cast((select max(first_seen_utc) from s) as date) - 60, false) too_old, cast(row_number() over (partition by mode order by coalesce(outcome = 'picked', false) desc, match_confidence desc nulls last, first_seen_utc desc, record_id) as integer) rank from s",
    "e30_facets": f"with {_ARCHIVE}, f as (select 'mode' facet, mode as value from a where audience = 'buyer' union all select 'audience', audience from a where mode = 'live' union all select 'platform', platform from a where mode = 'live' and audience = 'buyer' union all select 'kind', kind from a where mode = 'live' and audience = 'buyer') select facet, value, n from (select facet, value, count(*) n from f where value is not null group by facet, value) qualify row_number() over (partition by facet order by n desc, value) <= 60",
    "e31_sparkline": f"with {_ARCHIVE}, c as (select cast(first_seen_utc as date) as day, count(*) records, count(*) filter (audience = 'buyer') buyers from a where first_seen_utc is not null group by 1), s as (select cast(unnest(generate_series(min(day), max(day), interval 1 day)) as date) as day from c) select s.day, coalesce(records, 0) records, coalesce(buyers, 0) buyers from s left join c using (day)",
    "b10_merge": f"with {_NEWEST}, x as (select record_id, nullif(title, '') title, nullif(excerpt, '') excerpt, nullif(text_hash, '') text_hash, nullif(audience, '') audience, nullif(community, '') community, 1 one from signals), y as (select record_id, title, excerpt, text_hash, audience, community, 1 one from m) select coalesce(x.record_id, y.record_id) record_id, case when x.one is null then 'new' when y.one is null then 'absent' when x.title is distinct from y.title or x.excerpt is distinct from y.excerpt or x.text_hash is distinct from y.text_hash or x.audience is distinct from y.audience or x.community is distinct from y.community then 'edited' else 'seen_again' end change from x full join y on x.record_id = y.record_id",
    "d07_mark_closed": f"with {_ARCHIVE}, o as (select record_id, community from a where removed_utc is null), g as (select * from o where record_id not in (select record_id from signals_mirror)) select o.community, count(*) open_records, any_value(k.missing) missing, count(*) > 20 and any_value(k.missing) > count(*) * 0.5 guarded from o join (select community, count(*) missing from g group by 1) k on o.community = k.community group by o.community",
    "j01_stamps": f"select record_id, {_T('first_seen_utc')} first_seen_ms, {_T('last_seen_utc')} last_seen_ms from signals",
    "i22_routes": f"with {_ARCHIVE}, e as (select record_id, excerpt, regexp_extract(excerpt, '{EMAIL}') e, regexp_extract(excerpt, 'https?://[^\\s|)\\]]{{1,300}}') l from a where excerpt is not null) select record_id, case when length(excerpt) >= 600 and instr(excerpt, e) + length(e) - 1 = length(excerpt) then '' else e end email, case when length(excerpt) >= 600 and instr(excerpt, l) + length(l) - 1 = length(excerpt) then '' else l end link from e",
}
