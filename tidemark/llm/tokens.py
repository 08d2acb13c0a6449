"""Text sizes in tokens of a public tokenizer given as a rank file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Default rank file; any other is a parameter of the operators.
RANKS = os.environ.get("TIDEMARK_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: The split before the merges that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str) -> int:
    """Tokens of a whole text; a very long run without a break is cut by the pattern itself, never by us."""
    return len(encoding(path).encode_ordinary(text))


def sizes(df: DataFrame, record_id: str, text: str, *kept: str, ranks: str = RANKS) -> DataFrame:
    """``(id, kept..., tokens)``: one row per row of ``df``; a null text has null tokens, an empty one 0. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if t is None else count(t, ranks) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in ("id", *kept)], pa.array(n, pa.int64())], names=["id", *kept, "tokens"])

    rows = df.select(F.col(record_id).cast("bigint").alias("id"), *kept, F.col(text).cast("string").alias("text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in ("id", *kept)] + ["tokens bigint"]))
