"""Records that differ only in formatting: recursive radix partitions of canonical bytes, a counting trie in each.

The canonical bytes of a record are the 128-bit digest of its canonical form, so a bucket's prefix splits evenly however
the texts begin. Copies are combined where they are read: one state per content and input batch is all that is counted,
so a content that is a third of all rows is no bucket's burden. Buckets with more than ``BUCKET_STATES`` states are
split by their next byte until each fits; a bucket of one content cannot be split, and its trie holds one entry.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pairs import pairs_within
from tidemark.session import written

#: States one bucket should hold.
BUCKET_STATES = 500_000
_WIDE = Context(prec=100_000)


def text_form(text: str) -> str:
    """Letters and digits in order without case; composed and decomposed accents are the same letter."""
    if text.isascii():
        return "".join(filter(str.isalnum, text.lower()))
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return "".join(filter(str.isalnum, folded))


def _value(x: object) -> object:
    if isinstance(x, str):
        return ["text", text_form(x)]
    if isinstance(x, Decimal):
        return ["number", str(x.normalize(_WIDE)) if x else "0"]
    if isinstance(x, dict):
        return ["object", [[k, _value(x[k])] for k in sorted(x)]]
    if isinstance(x, list):
        return ["array", [_value(y) for y in x]]
    return x


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def array_form(text: str) -> str | None:
    """A readable, non-empty JSON array with fields in fixed order and text values in their text form; else null."""
    try:
        x = json.loads(text, parse_int=Decimal, parse_float=Decimal, parse_constant=_no_constant)
    except ValueError:
        return None
    return json.dumps(_value(x)) if isinstance(x, list) and x else None


class Trie:
    """Terminal counters by digest; a branch is opened only where two digests part."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, digest: bytes, n: int, first: int) -> None:
        node, at = self.root, 0
        while True:
            leaf = node.get(digest[at])
            if leaf is None:
                node[digest[at]] = [digest, n, first]
                return
            if isinstance(leaf, dict):
                node, at = leaf, at + 1
            elif leaf[0] == digest:
                leaf[1] += n
                leaf[2] = min(leaf[2], first)
                return
            else:
                node[digest[at]] = {leaf[0][at + 1]: leaf}

    def terminals(self) -> Iterator[list]:
        """``[digest, count, least id]`` of every content."""
        open_nodes = [self.root]
        while open_nodes:
            for x in open_nodes.pop().values():
                if isinstance(x, dict):
                    open_nodes.append(x)
                else:
                    yield x


def digests(df: DataFrame, record_id: str, content: str, form: Callable[[str], str | None]) -> DataFrame:
    """``(id, key)`` of every record whose content has a form; null contents have none. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b["id"].to_pylist(), b["content"].to_pylist()):
                if (f := form(text)) is not None:
                    ids.append(i)
                    keys.append(hashlib.blake2b(f.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    rows = df.select(F.col(record_id).cast("bigint").alias("id"), F.col(content).cast("string").alias("content")).where("content is not null and id is not null")
    return rows.mapInArrow(run, "id bigint, key binary")


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per content and batch."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by("key").aggregate([("id", "count"), ("id", "min")])
        yield t.select(["key", "id_count", "id_min"]).rename_columns(["key", "n", "first"]).combine_chunks().to_batches()[0] if len(t) else pa.RecordBatch.from_pylist([], pa.schema([("key", pa.binary()), ("n", pa.int64()), ("first", pa.int64())]))


def radix_buckets(states: DataFrame, bucket_states: int) -> list[bytes]:
    """Prefixes that cut the digests into buckets of at most ``bucket_states`` states, or of one digest.

    Each round counts the next byte of the oversized buckets only; what comes to the driver is at most 256 counts per
    oversized bucket.
    """
    done, oversized, depth = [], [b""], 0
    while oversized and depth < 16:
        depth += 1
        within = states if depth == 1 else states.where(F.substring("key", 1, depth - 1).isin([bytearray(p) for p in oversized]))
        counts = within.groupBy(F.substring("key", 1, depth).alias("p")).count().collect()
        done += [bytes(r["p"]) for r in counts if r["count"] <= bucket_states or depth == 16]
        oversized = [bytes(r["p"]) for r in counts if r["count"] > bucket_states and depth < 16]
    return done


def count_copies(keyed: DataFrame, *, bucket_states: int = BUCKET_STATES) -> DataFrame:
    """``(key, copies, first_id)`` of every content of ``keyed`` (id, key); an empty input gives no rows."""
    states = written(keyed.mapInArrow(_states, "key binary, n bigint, first bigint"), "copies-states")
    number = {p: i for i, p in enumerate(sorted(radix_buckets(states, bucket_states)))}
    depths = sorted({len(p) for p in number})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [next(number[k[:n]] for n in depths if k[:n] in number) for k in b["key"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b["key"], b["n"], b["first"]], names=["bucket", "key", "n", "first"])

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, bucket = Trie(), None

        def out() -> pa.RecordBatch:
            rows = list(trie.terminals())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["key", "copies", "first_id"])

        for b in batches:
            for at, k, n, first in zip(*(b[c].to_pylist() for c in ("bucket", "key", "n", "first"))):
                if at != bucket:
                    yield out()
                    trie, bucket = Trie(), at
                trie.add(k, n, first)
        yield out()

    cut = states.mapInArrow(place, "bucket int, key binary, n bigint, first bigint").repartition("bucket").sortWithinPartitions("bucket")
    return cut.mapInArrow(tries, "key binary, copies bigint, first_id bigint")


def same_content(df: DataFrame, record_id: str, content: str, form: Callable[[str], str | None], *, bucket_states: int = BUCKET_STATES) -> tuple[DataFrame, DataFrame]:
    """The contents ``(key, copies, first_id)`` and the pairs ``(id_a, id_b)`` of records that share one."""
    keyed = written(digests(df, record_id, content, form), "copies-digests")
    counted = count_copies(keyed, bucket_states=bucket_states)
    shared = keyed.join(counted.where("copies > 1").select("key"), "key", "left_semi")
    return counted, pairs_within(shared, "key", "id")
