"""Stateful streams: unbounded dedup, keyed upsert with revisions, unchanged threads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPSERT_OUT = "record_id string, first_seen bigint, last_seen bigint, sightings bigint, revisions bigint, removed boolean"
_UPSERT_STATE = "first_seen bigint, last_seen bigint, sightings bigint, revisions bigint, removed boolean, text string"


def first_sightings(stream: DataFrame, key: str) -> DataFrame:
    """The first row of every key, ever; rows without a key pass. The state is one entry per key and has no expiry."""
    return stream.where(F.col(key).isNotNull()).dropDuplicates([key])


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["at", "text"], kind="stable", na_position="first")
    first, last, seen, revisions, removed, text = state.get if state.exists else (None, None, 0, 0, False, None)
    for at, t, gone in zip(rows["at"], rows["text"], rows["removed"]):
        at = int(at)
        first, last = at if first is None else min(first, at), at if last is None else max(last, at)
        if gone:
            removed = True
            continue
        t = None if pd.isna(t) else t
        revisions += int(seen > 0 and t != text)
        seen, text, removed = seen + 1, t, False  # a new sighting reopens a removed record
    state.update((first, last, seen, revisions, removed, text))
    yield pd.DataFrame({"record_id": [key[0]], "first_seen": [first], "last_seen": [last], "sightings": [seen], "revisions": [revisions], "removed": [bool(removed)]})


def keyed_upsert(stream: DataFrame) -> DataFrame:
    """Of a stream (record_id, at, text, removed): the record's dates, sightings and revisions after each batch.

    No watermark: a sighting may come at any time and must reopen a removed record. A batch's rows of one key are
    folded in the order of ``at``; a row later in the stream but older counts as a sighting when it comes.
    """
    return stream.where("record_id is not null").groupBy("record_id").applyInPandasWithState(_fold, UPSERT_OUT, _UPSERT_STATE, "update", GroupStateTimeout.NoTimeout)


def latest_per_key(stream: DataFrame, key: str, value: str) -> DataFrame:
    """The greatest ``value`` of every key so far."""
    return stream.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias(value), F.count("*").alias("rows"))
