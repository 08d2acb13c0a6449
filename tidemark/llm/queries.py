"""Problems tagged llm: 2 (personal information), 3 (groups of the same complaint), 4 (new batches against history),
6 (copies in other formatting), 7 (containers of texts), 8 (mixing sources), 9 (characters that look
like others)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.llm import copies, history, lookalikes, mixing, mixture, packing, pii, tokens
from tidemark.llm.pairs import pairs_within
from tidemark.llm.winnow import canonical
from tidemark.session import table, written


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables, null texts too, with a typed placeholder for each item."""
    nuggets = pii.scan(table(spark, d, "nuggets"), "nuggets", "id", "raw_text")
    reviews = pii.scan(table(spark, d, "mixed_vote_score"), "mixed_vote_score", "recommendationid", "review")
    return nuggets.unionByName(reviews)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per record and type; a review crawled again is the same record."""
    return p2_redacted(spark, d).select("table_name", "record_id", F.explode("pii_types").alias("pii_type")).distinct()


#: The model name of rows embedded by a stand-in.
STAND_IN = "fake (hash)"


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    """``(id, group_id, density)``: every insight with its group, named by its most typical row."""
    return mixture.same_meaning(table(spark, d, "nuggets"), record_id="id", text="extracted_insight", model="embedding_model", left_out=F.col("embedding_model") == STAND_IN)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs_within(p3_members(spark, d), "group_id", "id").select(F.col("id_a").alias("nugget_id_a"), F.col("id_b").alias("nugget_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group of two or more with its model, size and three insights of highest density."""
    members = written(p3_members(spark, d), "groups")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1")
    rank = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("density"), "id"))
    top = members.withColumn("rank", rank).where("rank <= 3").join(sizes, "group_id")
    texts = table(spark, d, "nuggets").select("id", "embedding_model", "extracted_insight")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "extracted_insight"))), lambda x: x["extracted_insight"])
    return top.join(texts, "id").groupBy("group_id", "embedding_model", "size").agg(shown.alias("typical_insights"))


def _padded_key(name: str) -> Column:
    return F.lower(F.trim(F.col(name).cast("string")))


def p4_decisions(spark: SparkSession, d: str) -> DataFrame:
    """``(incoming_id, batch_no, decision, reason)`` of every incoming row, batch by batch; rows without a batch number come last.

    The store is built once over the whole history; each batch then reads of it only what its Bloom filters let through.
    """
    nuggets, seen, incoming = table(spark, d, "nuggets"), table(spark, d, "ingested_comments"), table(spark, d, "nuggets_incoming")
    store = history.new_history(spark, nuggets.count() + seen.count())
    known = seen.select(F.lit("fingerprint").alias("kind"), _padded_key("fingerprint").alias("value")).unionByName(nuggets.select(F.lit("key").alias("kind"), _padded_key("unique_key").alias("value")))
    store.add("build", known, nuggets.select(canonical(F.col("extracted_insight")).alias("text")))
    keys = [("fingerprint", _padded_key("fingerprint")), ("key", _padded_key("unique_key"))]
    numbers = sorted((r[0] for r in incoming.select("batch_no").distinct().collect()), key=lambda b: (b is None, b))
    parts = [store.check(incoming.where(F.col("batch_no").eqNullSafe(F.lit(b))), f"batch-{i}", keys, "incoming_id", "extracted_insight") for i, b in enumerate(numbers)]
    schema = "id bigint, reason string"
    refused = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    rows = incoming.select(F.col("incoming_id").alias("id"), "batch_no").join(refused, "id", "left")
    return rows.select(F.col("id").alias("incoming_id"), "batch_no", F.when(F.col("reason").isNull(), "accept").otherwise("refuse").alias("decision"), "reason")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_decisions(spark, d).where("decision = 'refuse'").select("incoming_id")


CONTENTS = {"nuggets": ("raw_text", copies.text_form), "ingest_batch": ("comments", copies.array_form)}


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parts = [copies.same_content(table(spark, d, t), "id", c, form)[1].select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, (c, form) in CONTENTS.items()]
    return reduce(DataFrame.unionByName, parts)


def p6_copies(spark: SparkSession, d: str) -> DataFrame:
    """One record of each content, that of the smallest id, and its number of copies."""
    parts = [copies.same_content(table(spark, d, t), "id", c, form)[0].select(F.lit(t).alias("table_name"), F.col("first_id").alias("id"), "copies") for t, (c, form) in CONTENTS.items()]
    return reduce(DataFrame.unionByName, parts)


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    return written(tokens.sizes(table(spark, d, "documents"), "doc_id", "text"), "sizes")


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of each piece of one longer than the capacity, for each pack size."""
    sizes = _token_sizes(spark, d)
    packs = table(spark, d, "pack_sizes").collect()  # a fixed, small table of parameters
    parts = [packing.pack(sizes, p["capacity_tokens"]).select(F.lit(p["pack_id"]).alias("pack_id"), F.col("id").alias("doc_id"), "piece", "tokens", "bucket", "container") for p in packs]
    return reduce(DataFrame.unionByName, parts)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Items, tokens and fill of every container of each pack size."""
    packs = table(spark, d, "pack_sizes").select("pack_id", "capacity_tokens")
    held = p7_assignment(spark, d).where("container is not null").groupBy("pack_id", "container").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return held.join(packs, "pack_id").withColumn("fill", F.round(F.col("tokens") / F.col("capacity_tokens"), 6))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").withColumn("text_key", F.md5("text"))
    return mixing.mix(written(tokens.sizes(docs, "doc_id", "text", "source", "text_key"), "sizes"), table(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mix with the number of times each is used."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, d)[1]


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every document, null and empty texts too, in its one form, and whether that differs."""
    return lookalikes.clean(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_clean(spark, d).where("changed").select("doc_id")


QUERIES = {"p9_found": p9_found, "p9_clean": p9_clean, "p6_found": p6_found, "p6_copies": p6_copies, "p7_assignment": p7_assignment, "p7_fill": p7_fill, "p8_selection": p8_selection, "p8_shares": p8_shares, "p2_found": p2_found, "p2_redacted": p2_redacted, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_decisions": p4_decisions}

#: The scan is no SQL expression; tests/test_p2.py has its cases.
ORACLE: dict[str, str] = {}
