"""Problem 1 (results per source and platform) and problem 5 (signals against their mirror)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import compare
from tidemark.operators.tree import frequent_keys, tree_aggregate
from tidemark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent_keys(table(spark, d, "ingest_batch"), ["platform", "source"], 0.05)


def p1_queue_stats(spark: SparkSession, d: str) -> DataFrame:
    """Batches, readable comments, failures and unreadable batches of every platform and source."""
    b = table(spark, d, "ingest_batch")
    size = F.json_array_length("comments")
    return tree_aggregate(
        b,
        {"platform": F.col("platform"), "source": F.col("source")},
        {"batches": F.lit(1), "comments": size, "failures": (F.col("status") == "failed").cast("int"), "unreadable": (F.col("comments").isNotNull() & size.isNull()).cast("int")},
    )


TEXT = "mode platform source_id source_url community kind author title excerpt text_hash query match_reason audience company buyer_intent run_id run_status error outcome outcome_note".split()
TIMES = "created_utc edited_utc removed_utc first_seen_utc last_seen_utc outcome_at".split()
INTS = ["relevant", "revisions"]


def _differences(spark: SparkSession, d: str) -> DataFrame:
    plain = (compare.text_value, compare.text_value)
    values = {c: plain for c in TEXT + INTS} | {c: (compare.instant_text, compare.instant_value) for c in TIMES} | {"match_confidence": (compare.rounded_value(4),) * 2}
    return compare.table_differences(
        table(spark, d, "signals"), table(spark, d, "signals_mirror"), key="record_id", values=values,
        left_order=compare.instant_millis(F.col("last_seen_utc")), right_order=F.unix_millis("last_seen_utc"), left_name="only_in_signals", right_name="only_in_signals_mirror",
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d).select("record_id", "difference")


def p5_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every difference with both values in their compared form."""
    return _differences(spark, d)


QUERIES = {"p1_found": p1_found, "p1_queue_stats": p1_queue_stats, "p5_found": p5_found, "p5_cells": p5_cells}


def _p5_sql(cells: bool) -> str:
    side = lambda t: lambda c: f"{t}.{c}"

    def form(c: str, x: str) -> str:
        if c in TIMES:
            return f"coalesce(cast(epoch_ms(try_cast({x} as timestamptz)) as varchar), nullif(cast({x} as varchar), ''))"
        if c == "match_confidence":
            return f"cast(cast(round(cast({x} as double), 4) as decimal(30,4)) as varchar)"
        return f"nullif(cast({x} as varchar), '')"

    l, r = side("l"), side("r")
    value = ", l.{c} left_value, r.{c} right_value" if cells else ""
    none = ", cast(null as varchar) left_value, cast(null as varchar) right_value" if cells else ""
    columns = TEXT + INTS + TIMES + ["match_confidence"]
    newest = lambda t: f"select record_id, {', '.join(f'{form(c, c)} {c}' for c in columns)} from {t} qualify row_number() over (partition by record_id order by try_cast(last_seen_utc as timestamptz) desc nulls last) = 1"
    parts = [
        f"select l.record_id, 'only_in_signals' difference{none} from l where not exists (select 1 from r where r.record_id is not distinct from l.record_id)",
        f"select r.record_id, 'only_in_signals_mirror' difference{none} from r where not exists (select 1 from l where r.record_id is not distinct from l.record_id)",
    ] + [f"select l.record_id, '{c}' difference{value.format(c=c)} from l join r on r.record_id is not distinct from l.record_id where {l(c)} is distinct from {r(c)}" for c in columns]
    return f"with l as ({newest('signals')}), r as ({newest('signals_mirror')}) " + " union all ".join(parts)


ORACLE = {
    "p1_found": """select field_name, key_value from (
        select 'platform' field_name, platform key_value, count(*) n from ingest_batch group by platform
        union all select 'source', source, count(*) from ingest_batch group by source)
        where key_value is not null and n >= 0.05 * (select count(*) from ingest_batch)""",
    "p1_queue_stats": """with b as (select *, case when json_valid(comments) then json_array_length(comments) end n from ingest_batch),
        s as (select 'platform' field_name, platform key_value, * from b union all select 'source', source, * from b)
        select field_name, key_value, count(*) batches, cast(coalesce(sum(n), 0) as bigint) comments,
               count(*) filter (where status = 'failed') failures, count(*) filter (where comments is not null and n is null) unreadable
        from s group by all""",
    "p5_found": _p5_sql(False),
    "p5_cells": _p5_sql(True),
}
