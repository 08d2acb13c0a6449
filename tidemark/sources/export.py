"""Exports: sharded CSV staged beside its place and moved at the end, with a manifest that can be checked."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: CSV that reads back as it was: quotes doubled, line breaks kept, null and empty text apart.
CSV = {"header": True, "quoteAll": False, "escape": '"', "multiLine": True, "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def identity(df: DataFrame, key: str) -> DataFrame:
    """``rows``, ``ids`` and a digest of the distinct ids that does not depend on their order; one row, no collecting."""
    ids = df.select(F.coalesce(F.col(key).cast("string"), F.lit("\\N")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("ids"), F.sha2(F.concat_ws(":", F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64(F.reverse("k"), "k")), F.count("*")), 256).alias("digest"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def export_csv(df: DataFrame, path: str, key: str, *, by: Sequence[str] = (), rows_per_file: int = 1_000_000) -> dict:
    """Write ``df`` as CSV shards (by the values of ``by``, at most ``rows_per_file`` rows each) and a manifest; return it.

    The shards are written to a staging folder, read back and compared with the input by rows and ids; only then are
    they moved to ``path``, and the manifest is written last, so a reader that waits for it never sees half an export.
    """
    spark, staging = df.sparkSession, f"{path}.staging"
    shard = df.select(*df.columns, *[F.coalesce(F.col(c).cast("string"), F.lit("none")).alias(f"of_{c}") for c in by])
    writer = shard.write.mode("overwrite").options(**CSV).option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*[f"of_{c}" for c in by]) if by else writer).csv(staging)
    before = identity(df, key).first().asDict()
    after = identity(read_csv(spark, staging, df), key).first().asDict()
    if before != after:
        raise OSError(f"export of {before} reads back as {after}")
    fs, to = _fs(spark, path)
    fs.delete(to, True)
    fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staging), to)
    manifest = {**before, "columns": df.columns, "by": list(by), "rows_per_file": rows_per_file}
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def read_csv(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """An export as it was, with the schema of ``like``; shard columns are left out."""
    return spark.read.options(**CSV).option("recursiveFileLookup", True).schema(like.schema).csv(path)
