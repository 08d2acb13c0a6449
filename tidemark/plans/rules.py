"""Rule families over signals and documents, and the text checks around them. The phrases are parameters; these occur in the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import rules as R
from tidemark.operators.relational import top_k_per
from tidemark.plans.signals import archive
from tidemark.session import table

RULES = R.Rules((
    R.Family("pain", "buyer", 0.4, ("i gave up on", "third week of fighting", "still can't", "i'd rather", "honestly")),
    R.Family("ask", "buyer", 0.3, ("does anyone", "anyone else", "i wish someone", "what i want is boring")),
    R.Family("setup", "practitioner", 0.45, ("my setup", "log line", "we moved", "after v")),
    R.Family("offer", "reject", 1.0, ("offered us", "is looking for a", "seats at")),
))
KINDS = [("print", "print"), ("calendar", "calendar"), ("import", "import"), ("login", "login"), ("billing", "bill")]
TELLS = {"honestly": 1.0, "to be fair": 1.0, "in the end": 0.5, "for the record": 1.5, "oddly": 0.5}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).select("record_id", "platform", "community", F.concat_ws(" ", "title", "excerpt").alias("text"))


def i02_classified(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("record_id", R.classify(F.col("text"), RULES).alias("c")).select("record_id", "c.*")


def i03_audience_counts(spark: SparkSession, d: str) -> DataFrame:
    return i02_classified(spark, d).groupBy("audience").agg(F.count("*").alias("records"), F.count_if("ambiguous").alias("ambiguous"), F.round(F.avg("score"), 6).alias("mean_score"))


def i06_reason_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Phrases read back from the reasons just written, with their records."""
    p = i02_classified(spark, d).select(F.explode(R.matched_phrases(F.col("reason"))).alias("phrase"))
    return p.groupBy("phrase").agg(F.count("*").alias("records"))


def c08_profile_filter(spark: SparkSession, d: str) -> DataFrame:
    keep = R.keep_by_words(F.col("text"), ("export", "import", "upload"), ("cloud", "lettings"))
    return _texts(spark, d).groupBy("platform").agg(F.count("*").alias("records"), F.count_if(keep).alias("kept"))


def c09_first_rule(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).groupBy(R.first_rule(F.col("text"), KINDS, "other").alias("kind")).agg(F.count("*").alias("records"))


def c10_adverts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether they begin like an advert, ask something, or neither."""
    head = F.lower(F.substring("text", 1, 200))
    kind = F.when(head.rlike(r"^\s*\[(for sale|offer|hiring)\]|is looking for|seats at"), "advert").when(F.rtrim("text").endswith("?"), "question").otherwise("other")
    return table(spark, d, "documents").where("text is not null").groupBy("text_kind", kind.alias("kind")).agg(F.count("*").alias("documents"))


def c15_work_queue(spark: SparkSession, d: str) -> DataFrame:
    return archive(spark, d).where("audience = 'buyer' and removed_utc is null and outcome is null").groupBy("mode", "platform").agg(F.count("*").alias("records"))


def c18_gate(spark: SparkSession, d: str) -> DataFrame:
    """Citations of incoming rows by batch that are all in the archive: one violation row per batch with any outside."""
    keys = table(spark, d, "nuggets").select("unique_key").where("unique_key is not null").distinct().withColumn("known", F.lit(1))
    cited = table(spark, d, "nuggets_incoming").where("unique_key is not null").join(keys, "unique_key", "left")
    return cited.groupBy("batch_no").agg(F.count("*").alias("cited"), F.count_if(F.col("known").isNull()).alias("outside")).where("outside > 0")


def c19_unchanged_threads(spark: SparkSession, d: str) -> DataFrame:
    """Threads whose queue advertises no more comments than the archive has already."""
    said = table(spark, d, "ingest_batch").where("thread_id is not null").groupBy("platform", "thread_id").agg(F.max(F.coalesce(F.json_array_length("comments"), F.lit(0))).alias("advertised"))
    had = table(spark, d, "nuggets").where("thread_id is not null").groupBy("platform", "thread_id").agg(F.count("*").alias("seen"))
    return said.join(had, ["platform", "thread_id"]).where("advertised <= seen").select("platform", "thread_id", "advertised", "seen")


def i27_prose_lint(spark: SparkSession, d: str) -> DataFrame:
    """Weighted tells per document; three and more fail."""
    low, score = F.lower("text"), F.lit(0.0)
    for p, w in TELLS.items():
        score = score + F.regexp_count(low, F.lit(p)) * w
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.round(score, 2).alias("score"), (score >= 3).alias("fails"))


def i30_figures(spark: SparkSession, d: str) -> DataFrame:
    """Amounts named in each document: how many, the largest and their sum."""
    found = F.regexp_extract_all("text", F.lit(r"\$(\d{1,3}(?:,\d{3})*|\d+)"), F.lit(1))
    each = table(spark, d, "documents").select("doc_id", F.explode(found).alias("f")).withColumn("v", F.replace("f", F.lit(","), F.lit("")).cast("bigint"))
    return each.groupBy("doc_id").agg(F.count("*").alias("figures"), F.max("v").alias("largest"), F.sum("v").alias("total"))


def i32_paragraph_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents that occur in more than one, by the hash of their normal form."""
    paras = F.explode(F.array_distinct(F.transform(F.split("text", r"\n+"), lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " ")))))
    each = table(spark, d, "documents").select("doc_id", paras.alias("p")).where("p <> ''")
    return each.groupBy(F.substring(F.sha2("p", 256), 1, 16).alias("hash")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


def g11_synthesis_chunks(spark: SparkSession, d: str, cap: int = 5) -> DataFrame:
    """Each category's newest nuggets of a run in chunks of ``cap``; a single left over joins the chunk before."""
    n = table(spark, d, "nuggets").where("category is not null").select("category", "run_id", "id")
    n = top_k_per(n, ["category", "run_id"], [F.asc("id")], 1_000_000, "rn")
    sizes = n.groupBy("category", "run_id").agg(F.max("rn").alias("n"))
    chunk = F.floor((F.col("rn") - 1) / cap)
    folded = F.when((F.col("n") > cap) & (F.col("n") % cap == 1) & (F.col("rn") == F.col("n")), chunk - 1).otherwise(chunk)
    return n.join(sizes, ["category", "run_id"]).groupBy("category", "run_id", folded.cast("int").alias("chunk")).agg(F.count("*").alias("members"))


def d14_overlap_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each run's nuggets' thread set assigned to the community it shares most threads with; ties the first by name, none is ''."""
    runs = table(spark, d, "ingest_batch").where("thread_id is not null").select("source", "thread_id").where("source is not null").distinct()
    homes = table(spark, d, "nuggets").where("thread_id is not null and community is not null").select("community", "thread_id").distinct()
    shared = runs.join(homes, "thread_id").groupBy("source", "community").agg(F.count("*").alias("shared"))
    best = top_k_per(shared, ["source"], [F.desc("shared"), F.asc("community")], 1).select("source", "community", "shared")
    return runs.select("source").distinct().join(best, "source", "left").select("source", F.coalesce("community", F.lit("")).alias("community"), F.coalesce("shared", F.lit(0)).alias("shared"))


def d15_containment(spark: SparkSession, d: str) -> DataFrame:
    """For each author's set of threads, the smallest community whose threads hold all of it; ties by name."""
    n = table(spark, d, "nuggets").where("thread_id is not null")
    want = n.where("author is not null").select("author", "thread_id").distinct()
    have = n.where("community is not null").select("community", "thread_id").distinct()
    size = want.groupBy("author").agg(F.count("*").alias("wanted"))
    support = have.groupBy("community").agg(F.count("*").alias("support"))
    full = want.join(have, "thread_id").groupBy("author", "community").agg(F.count("*").alias("shared")).join(size, "author").where("shared = wanted").join(support, "community")
    return top_k_per(full, ["author"], [F.asc("support"), F.asc("community")], 1).select("author", "community", "wanted", "support")


def d16_same_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose sets of threads are exactly equal."""
    sets = table(spark, d, "ingest_batch").where("thread_id is not null and source is not null").groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("thread_id")), "\n"), 256).alias("k"), F.count_distinct("thread_id").alias("threads"))
    return sets.groupBy("k", "threads").agg(F.count("*").alias("sources"), F.min("source").alias("first_source")).where("sources > 1").select("threads", "sources", "first_source")


def h07_merged_support(spark: SparkSession, d: str) -> DataFrame:
    """Threads of the queue and of the archive per platform as one set."""
    a = table(spark, d, "ingest_batch").select("platform", "thread_id", F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = table(spark, d, "nuggets").select("platform", "thread_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    each = a.unionByName(b).where("platform is not null and thread_id is not null").groupBy("platform", "thread_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.groupBy("platform").agg(F.count("*").alias("threads"), F.count_if(F.col("a") + F.col("b") == 2).alias("shared"))


def g06_source_plan(spark: SparkSession, d: str) -> DataFrame:
    """Sources grouped by their rate against the median of the rates above zero: hot, warm, zero, or fresh without batches."""
    from tidemark.plans.queue import e37_source_rates, e38_rate_watermark

    rates = e37_source_rates(spark, d).crossJoin(e38_rate_watermark(spark, d).select("watermark"))  # one row
    group = F.when(F.col("rate") == 0, "zero").when(F.col("rate") >= F.col("watermark"), "hot").otherwise("warm")
    return rates.groupBy(group.alias("plan")).agg(F.count("*").alias("sources"), F.sum("nuggets").alias("nuggets"))


def a14_newest_per_source(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    b = table(spark, d, "ingest_batch").where("source is not null")
    return top_k_per(b, ["source"], [F.desc("id")], n).select("source", "id", "status", "rank")


def e36_coverage_drop(spark: SparkSession, d: str, window: int = 10, drop: float = 0.3) -> DataFrame:
    """Share of comments with each field in a platform's newest ``window`` batches against the pooled share before."""
    b = table(spark, d, "ingest_batch").where("platform is not null and json_array_length(comments) > 0")
    newest = top_k_per(b.select("platform", "id"), ["platform"], [F.desc("id")], window).select("id", F.lit(True).alias("new"))
    c = b.select("platform", "id", F.explode(F.from_json("comments", "array<struct<author:string,score:bigint,likes:bigint,edited:boolean>>")).alias("c")).join(newest, "id", "left")
    fields = ["author", "score", "likes", "edited"]
    each = c.select("platform", F.coalesce("new", F.lit(False)).alias("new"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"c.{f}").isNotNull().alias("has")) for f in fields])))
    s = each.groupBy("platform", "field").agg(F.avg(F.when(F.col("new"), F.col("has").cast("double"))).alias("now"), F.avg(F.when(~F.col("new"), F.col("has").cast("double"))).alias("base"))
    return s.where("base > 0").select("platform", "field", F.round("now", 6).alias("now"), F.round("base", 6).alias("base"), F.coalesce(F.col("base") - F.col("now") >= drop, F.lit(False)).alias("dropped"))


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "abcdefghijklmn" and k[1:3].isdigit() and v.__module__ == __name__}

_A = "t as (select record_id, nullif(platform, '') platform, concat_ws(' ', nullif(title, ''), nullif(excerpt, '')) x, lower(regexp_replace(concat_ws(' ', nullif(title, ''), nullif(excerpt, '')), 'https?://\\S+', ' ', 'g')) low from signals)"
_q = lambda s: s.replace("'", "''")
_HIT = lambda p: f"regexp_matches(' ' || low || ' ', '[^\\w]{_q(p)}[^\\w]')"
_ANY = lambda f: "(" + " or ".join(_HIT(p) for p in f.phrases) + ")"
_SUM = lambda role: "round(" + " + ".join(f"case when {_ANY(f)} then {f.weight}::double else 0 end" for f in RULES.families if f.role == role) + ", 3)"
_REJ = " or ".join(_ANY(f) for f in RULES.families if f.role == "reject")
_LIST = "list_filter([" + ", ".join(f"case when {_HIT(p)} then '{_q(p)}' end" for f in RULES.families for p in f.phrases) + "], lambda z: z is not null)[1:4]"
_CLS = f"{_A}, s as (select record_id, {_SUM('buyer')} b, {_SUM('practitioner')} p, ({_REJ}) r, {_LIST} w from t), c as (select record_id, case when r then 'none' when b >= 0.5 and b >= p then 'buyer' when p >= 0.4 then 'practitioner' when b >= 0.5 then 'buyer' else 'none' end audience, greatest(b, p) score, not r and b >= 0.5 and p >= 0.4 and abs(b - p) < 0.15 ambiguous, case when len(w) > 0 then '[matched: ' || array_to_string(w, ', ') || ']' else '' end reason, w from s)"
_LOWX = "lower(x)"
_HAS = lambda parts: "(" + " or ".join(f"contains({_LOWX}, '{p}')" for p in parts) + ")"
ORACLE = {
    "i02_classified": f"with {_CLS} select record_id, audience, score, ambiguous, reason from c",
    "i03_audience_counts": f"with {_CLS} select audience, count(*) records, count(*) filter (ambiguous) as ambiguous, round(avg(score), 6) mean_score from c group by audience",
    "i06_reason_round_trip": f"with {_CLS}, u as (select unnest(w) phrase from c) select phrase, count(*) records from u group by phrase",
    "c08_profile_filter": f"with {_A} select platform, count(*) records, count(*) filter ({_HAS(['export', 'import', 'upload'])} and not {_HAS(['cloud', 'lettings'])}) kept from t group by platform",
    "c09_first_rule": f"with {_A} select case " + " ".join(f"when contains({_LOWX}, '{p}') then '{n}'" for n, p in KINDS) + " else 'other' end kind, count(*) records from t group by 1",
    "c10_adverts": "select text_kind, case when regexp_matches(lower(substr(text, 1, 200)), '^\\s*\\[(for sale|offer|hiring)\\]|is looking for|seats at') then 'advert' when rtrim(text, ' ') like '%?' then 'question' else 'other' end kind, count(*) documents from documents where text is not null group by 1, 2",
    "c15_work_queue": "select nullif(mode, '') as mode, nullif(platform, '') platform, count(*) records from signals where audience = 'buyer' and coalesce(removed_utc, '') = '' and coalesce(outcome, '') = '' group by 1, 2",
    "c18_gate": "select batch_no, count(*) cited, count(*) filter (unique_key not in (select unique_key from nuggets where unique_key is not null)) outside from nuggets_incoming where unique_key is not null group by batch_no having count(*) filter (unique_key not in (select unique_key from nuggets where unique_key is not null)) > 0",
    "c19_unchanged_threads": "with s as (select platform, thread_id, max(coalesce(case when json_valid(comments) then json_array_length(comments) end, 0)) advertised from ingest_batch where thread_id is not null group by 1, 2), h as (select platform, thread_id, count(*) seen from nuggets where thread_id is not null group by 1, 2) select s.platform, s.thread_id, cast(advertised as integer) advertised, seen from s join h on s.platform = h.platform and s.thread_id = h.thread_id where advertised <= seen",
    "i27_prose_lint": "select doc_id, round(" + " + ".join(f"len(regexp_extract_all(lower(text), '{p}')) * {w}::double" for p, w in TELLS.items()) + ", 2) score, (" + " + ".join(f"len(regexp_extract_all(lower(text), '{p}')) * {w}::double" for p, w in TELLS.items()) + ") >= 3 fails from documents where text is not null",
    "i30_figures": "with e as (select doc_id, cast(replace(unnest(regexp_extract_all(text, '\\$(\\d{1,3}(?:,\\d{3})*|\\d+)', 1)), ',', '') as bigint) v from documents) select doc_id, count(*) figures, max(v) largest, cast(sum(v) as bigint) total from e group by doc_id",
    "i32_paragraph_hashes": "with e as (select distinct doc_id, trim(regexp_replace(lower(unnest(regexp_split_to_array(text, '\\n+'))), '[^a-z0-9]+', ' ', 'g')) p from documents) select substr(sha256(p), 1, 16) as hash, count(*) documents, min(doc_id) first_doc from e where p <> '' group by 1 having count(*) > 1",
    "g11_synthesis_chunks": "with r as (select category, run_id, row_number() over (partition by category, run_id order by id) rn, count(*) over (partition by category, run_id) n from nuggets where category is not null), c as (select category, run_id, case when n > 5 and n % 5 = 1 and rn = n then (rn - 1) // 5 - 1 else (rn - 1) // 5 end chunk from r) select category, run_id, cast(chunk as integer) chunk, count(*) members from c group by all",
    "d14_overlap_assignment": "with a as (select distinct source, thread_id from ingest_batch where thread_id is not null and source is not null), h as (select distinct community, thread_id from nuggets where thread_id is not null and community is not null), s as (select source, community, count(*) shared from a join h using (thread_id) group by all qualify row_number() over (partition by source order by shared desc, community) = 1) select x.source, coalesce(s.community, '') community, coalesce(s.shared, 0) shared from (select distinct source from a) x left join s on s.source = x.source".replace("group by all qualify", "group by source, community qualify"),
    "d15_containment": "with w as (select distinct author, thread_id from nuggets where thread_id is not null and author is not null), h as (select distinct community, thread_id from nuggets where thread_id is not null and community is not null), z as (select author, count(*) wanted from w group by 1), u as (select community, count(*) support from h group by 1), f as (select author, community, count(*) shared from w join h using (thread_id) group by 1, 2) select f.author, f.community, wanted, support from f join z using (author) join u using (community) where shared = wanted qualify row_number() over (partition by f.author order by support, f.community) = 1",
    "d16_same_evidence": "with s as (select source, list_sort(list(distinct thread_id)) k from ingest_batch where thread_id is not null and source is not null group by 1) select len(k) threads, count(*) sources, min(source) first_source from s group by k having count(*) > 1",
    "h07_merged_support": "with a as (select distinct platform, thread_id from ingest_batch where thread_id is not null), b as (select distinct platform, thread_id from nuggets where thread_id is not null), u as (select platform, thread_id, count(*) n from (select * from a union all select * from b) group by 1, 2) select platform, count(*) threads, count(*) filter (n = 2) shared from u where platform is not null group by platform",
    "a14_newest_per_source": "select source, id, status, cast(row_number() over (partition by source order by id desc) as integer) rank from ingest_batch where source is not null qualify rank <= 5",
    "e36_coverage_drop": "with b as (select platform, id, comments, json_array_length(comments) n from (select * from ingest_batch where platform is not null and json_valid(comments)) where json_array_length(comments) > 0), r as (select *, row_number() over (partition by platform order by id desc) <= 10 new from b), c as (select platform, new, comments, unnest(range(cast(n as bigint))) i from r), f as (select platform, new, field, json_extract_string(comments, '$[' || i || '].' || field) is not null has from c, (values ('author'), ('score'), ('likes'), ('edited')) v(field)), s as (select platform, field, avg(has::int) filter (new) now, avg(has::int) filter (not new) base from f group by 1, 2) select platform, field, round(now, 6) as now, round(base, 6) base, coalesce(base - now >= 0.3, false) dropped from s where base > 0",
}

from tidemark.plans import queue as _queue  # noqa: E402  # its oracle is part of this one

ORACLE["g06_source_plan"] = f"with s as ({_queue.ORACLE['e37_source_rates']}), w as (select round(median(rate), 6) m from s where rate > 0) select case when rate = 0 then 'zero' when rate >= m then 'hot' else 'warm' end plan, count(*) sources, cast(sum(nuggets) as bigint) nuggets from s, w group by 1"
